"""Media columns, token files and both tokenizers against the plain ways."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from sightline.llm import matroska as mkv
from sightline.llm import token_files, word_bpe
from sightline.llm.byte_bpe import Encoder
from sightline.session import scratch_dir

ODD_TEXTS = [None, "", " ", "\n", "a", "  a  ", "a\n\n b", "\t x", "İß ΑΣ é", "<|endoftext|> x", "x" * 70_000, "1 2's", "\x1c\x00", "a\xa0 b"]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[n], t, "shadow") for n, (i, t) in enumerate(enumerate(texts))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string")


def test_store_round_trip_and_packets(spark):
    texts = [*ODD_TEXTS, "y" * 576, "z" * 577, "w" * (576 * 200)]
    stored = mkv.with_media(docs(spark, texts)).cache()
    assert stored.columns == ["doc_id", "text", "ids", "media"]
    got = {r["doc_id"]: r for r in mkv.features(stored).collect()}
    packets = {}
    for r in mkv.packets(stored, "doc_id").collect():
        packets.setdefault(r["doc_id"], []).append(r)
    media = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        row = got[i]
        assert row["payload_bytes"] == len(payload) and row["payload_bytes"] % 576 == 0
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(payload[-32:])
        assert row["media_sha256"] == hashlib.sha256(media[i]).hexdigest() and row["media_bytes"] == len(media[i])
        own = sorted(packets[i], key=lambda p: p["begin"])
        assert b"".join(media[i][p["begin"] : p["end"]] for p in own) == payload
        assert [p["timestamp"] for p in own if p["frame"] == 0] == [72 * 8 * k for k in range(-(-len(own) // 8))]
    assert got[0]["media_sha256"] == got[1]["media_sha256"]  # null and empty alike


def test_parser_follows_every_kind_of_lacing_and_unknown_sizes():
    def block(lacing, head, frames, track=2):
        return mkv.number(track) + struct.pack(">hB", -5, lacing << 1) + head + b"".join(frames)

    frames = [b"a" * 300, b"b" * 10, b"c" * 255, b"d" * 7]
    xiph = bytes([3]) + bytes([255, 45]) + bytes([10]) + bytes([255, 0])
    signed = lambda d, w: ((d + (1 << (7 * w - 1)) - 1) | 1 << (7 * w)).to_bytes(w, "big")
    ebml = bytes([3]) + mkv.number(300) + signed(-290, 2) + signed(245, 2)
    even = [b"e" * 4] * 3
    group = mkv.element(mkv.BLOCK_GROUP, mkv.element(mkv.BLOCK, block(mkv.EBML_LACING, ebml, frames)) + mkv.element(mkv.REFERENCE, b"\xff"))
    body = mkv.unsigned(mkv.TIMESTAMP, 1000) + mkv.element(mkv.SIMPLE_BLOCK, block(mkv.XIPH, xiph, frames)) + group
    body += mkv.element(mkv.SIMPLE_BLOCK, block(mkv.FIXED, bytes([2]), even)) + mkv.element(mkv.SIMPLE_BLOCK, block(mkv.NO_LACING, b"", [b"q"], 300))
    unknown = lambda ident, inner: ident.to_bytes(4, "big") + b"\xff" + inner
    data = mkv._HEADER + unknown(mkv.SEGMENT, mkv._TRACKS + unknown(mkv.CLUSTER, body) + unknown(mkv.CLUSTER, body))
    media = mkv.parse(data)
    assert [data[p[6] : p[7]] for p in media.packets] == (frames + frames + even + [b"q"]) * 2
    assert {p[2] for p in media.packets} == {995} and {p[1] for p in media.packets} == {2, 300}
    assert [p[3] for p in media.packets[:8]] == [False] * 8 and len(media.clusters) == 2


@pytest.mark.parametrize("data", [b"", b"\x00", b"RIFF1234", mkv._HEADER[:-3], mkv.store(b"x" * 576)[:-4]])
def test_broken_files_are_refused(data):
    with pytest.raises((mkv.Broken, IndexError)):
        media = mkv.parse(data)
        raise mkv.Broken(str(media.tracks))


def test_byte_ids_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own, rnd = Tokenizer.from_file(path), Encoder(path), random.Random(4)
    parts = [" ", "  ", "\n", "\t", "The", "the", "12", "'s", "é", ".", ",", "<|endoftext|>", "<|", "\0", "\x1c", "\xa0", "ß!", "中文"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 10))) for _ in range(5000)]
    ids, counts = own.encode(texts)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == expected


def test_token_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD_TEXTS, "the same", "the same"]
    ids = [*range(len(ODD_TEXTS) - 1, -1, -1), 100, 100]
    folder = f"{scratch_dir(spark, 'tokens')}/files"
    token_files.write(docs(spark, texts, ids).repartition(3), folder, path, end=2, parts=4)
    rows = sorted(tuple(r) for r in token_files.index(spark, folder).collect())
    expected, start = [], 0
    for i, text in sorted(zip(ids, texts), key=lambda x: x[0]):
        tokens = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert rows == expected
    one = token_files.read(spark, folder).filter("doc_id = 100").collect()
    assert len(one) == 2 and one[0]["tokens"][-1] == 2
    empty = f"{scratch_dir(spark, 'tokens')}/files"
    token_files.write(docs(spark, ["x"]).limit(0), empty, path, end=2, parts=4)
    assert token_files.index(spark, empty).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = [b"tap", b"taps", b"top", b"tops", b"\xc3\xa9", b"a"]
    entries = [(w, list(range(i + 1))) for i, w in enumerate(words)]
    (tmp_path / "lexicon").write_bytes(word_bpe.compile_lexicon(entries))
    held = word_bpe.Lexicon(str(tmp_path / "lexicon"))
    ranks = held.ranks([*words, b"", b"t", b"ta", b"tapss", b"z", b"\xc3"])
    assert ranks[:6].tolist() == [sorted(words).index(w) for w in words] and (ranks[6:] == -1).all()
    ids, sizes = held.ids_of(ranks[:6])
    assert sizes.tolist() == [1, 2, 3, 4, 5, 6] and ids.tolist() == [x for _, own in entries for x in own]
    # The root, what follows "t", what follows "ta" and "to", what follows their "p", the end, the lead byte of é.
    assert len(held.accepts) == 6
    (tmp_path / "none").write_bytes(word_bpe.compile_lexicon([]))
    assert word_bpe.Lexicon(str(tmp_path / "none")).ranks([b"a"]).tolist() == [-1]


def test_word_bpe_round_trip_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, rnd = Tokenizer.from_file(path), random.Random(9)
    parts = ["The", " ", "the", "\n", "it's", "É", "12", ".", "\xa0", "İ", "<|startoftext|>", "ab́", "\t"]
    texts = [*ODD_TEXTS, *["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(400)]]
    frame = docs(spark, texts)
    lexicon = word_bpe.lexicon_of(frame, path, most=20)
    got = {r["doc_id"]: r for r in word_bpe.round_trip(frame, path, lexicon).collect()}
    back = {r["doc_id"]: r for r in word_bpe.decode(word_bpe.encode(frame, path, lexicon), path).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids) and back[i]["ids"] == ids and back[i]["decoded"] == decoded
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert word_bpe.round_trip(frame.limit(0), path, word_bpe.lexicon_of(frame.limit(0), path)).count() == 0


def test_plain_words_merge_as_the_library_does():
    rnd = random.Random(5)
    letters = [chr(c) for c in range(0x41, 0x260)] + list("abcdefghijklmnop") * 20 + list("ÉÀÜß") * 10
    texts = ["".join(rnd.choices(letters, k=rnd.randint(1, 9))) + rnd.choice(["", ".", ",", "!!", "'s", "?!"]) for _ in range(6000)]
    texts += [f"a{chr(c)}b" for c in range(1, 0x400)]
    for own, name in ((word_bpe.Coder, "word_bpe_49k.json"), (Encoder, "byte_bpe_50k.json")):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        ids, counts = own(public_tokenizers.path(name)).encode(texts)
        expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == expected


def test_encoder_keeps_repeated_pieces_and_no_whole_texts(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), Encoder(path)

    def same(texts):
        ids, counts = own.encode(texts)
        wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for w in wanted for i in w] and counts.tolist() == [len(w) for w in wanted]

    long = "far  apart \n\n" * 5_000
    same(["one two, three", long, "x <|endoftext|> y"])
    assert own._chars < 100  # the doubtful text itself isn't kept
    same(["two, three\nfour", "one two, 日本 two,"])
    monkeypatch.setattr("sightline.llm.byte_bpe.MOST_PIECES", 12)
    kept = {k: own._ids[own._starts[p] : own._starts[p] + own._sizes[p]].tolist() for k, p in own._place.items()}
    own._thin()
    assert {"two,", " one"} <= set(own._place) and "日本" not in own._place
    assert all(own._ids[own._starts[p] : own._starts[p] + own._sizes[p]].tolist() == kept[k] for k, p in own._place.items())
    same(["one two, five", " a \xa0 b", ""])


def test_workers_give_back_what_other_operators_left():
    import gc
    import weakref

    import pyarrow as pa

    from sightline.llm import byte_bpe, jaccard_join

    own = word_bpe.coder(public_tokenizers.path("word_bpe_49k.json"))
    assert word_bpe.coder(public_tokenizers.path("word_bpe_49k.json")) is own  # kept between tasks of its own
    first = weakref.ref(own)
    del own
    other = byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    gc.collect()
    assert first() is None
    second = weakref.ref(other)
    del other
    list(jaccard_join._read(iter([pa.record_batch([pa.array(["a b c d e f"])], ["text"])]), 0, 5))
    gc.collect()
    assert second() is None
