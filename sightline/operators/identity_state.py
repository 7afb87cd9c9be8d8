"""Identities as a stored state that batches of matched tracks are folded into.

A batch touches some identities. Only the buckets that hold them are read, and
only their rows are written anew (``sources.store``): counts add up, the ring
of recent assets and the capped anchors follow from what the row held and what
the batch brings, summed up per identity before the two meet. A batch carries
its writer's epoch; folded twice it counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.config import IDENTITY, IdentitySettings
from sightline.operators import identity
from sightline.session import cut_lineage
from sightline.sources.store import EvidenceStore

SCHEMA = (
    "face_key string, label string, lifecycle string, promotion_reason string, reference_id string, reference_name string, "
    "reference_pack string, observation_count bigint, quality double, cover_asset string, "
    "cover_box struct<x1:double,y1:double,x2:double,y2:double>, cover_quality double, asset_ids array<string>, "
    "anchors array<struct<model_key:string,quality:double,vector:array<float>>>"
)
TABLE, KEY = "identities", ["face_key"]


class IdentityState:
    """The stored identities under ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.store = EvidenceStore(spark, root, {TABLE: StructType.fromDDL(SCHEMA)}, buckets, KEY)

    def read(self, version: int | None = None) -> DataFrame:
        return self.store.read(TABLE, version)

    def known(self, keys: DataFrame) -> DataFrame:
        """The identities with the ``face_key`` values of ``keys``."""
        return self.store.lookup(TABLE, keys, KEY)

    def put(self, identities: DataFrame, writer: str | None = None, epoch: int | None = None) -> bool:
        """Insert identities, or replace those of the same key."""
        return self._replace(identities, writer, epoch)

    def fold(
        self,
        assignments: DataFrame,
        anchors: DataFrame,
        writer: str | None = None,
        epoch: int | None = None,
        cfg: IdentitySettings = IDENTITY,
    ) -> bool:
        """Fold a batch (as ``identity.update_identities`` takes it) into the identities it names; whether it was applied.

        Tracks of identities that aren't stored have nothing to be folded
        into and are left out.
        """
        if writer is not None and self.store.applied(writer, epoch):
            return False
        named = assignments.select("face_key").unionByName(anchors.select("face_key")).filter(F.col("face_key").isNotNull())
        held = cut_lineage(self.known(named))
        here = held.select("face_key")
        assigned, fresh = (df.join(here, KEY, "left_semi") for df in (assignments, anchors))
        return self._replace(identity.update_identities(held, assigned, fresh, cfg), writer, epoch)

    def commit(self, changes: DataFrame, writer: str | None = None, epoch: int | None = None) -> bool:
        """Apply the changes that ``identity.commit_identities`` finds."""
        gone = changes.filter(F.col("action") == "delete").select("face_key")
        return self._replace(changes.filter(F.col("action") != "delete").select(*identity.COLUMNS), writer, epoch, gone)

    def _replace(self, rows: DataFrame, writer: str | None, epoch: int | None, gone: DataFrame | None = None) -> bool:
        if writer is not None and self.store.applied(writer, epoch):
            return False
        rows = cut_lineage(rows.select(*identity.COLUMNS))
        change = self.store.change()
        keys = rows.select("face_key")
        change.take_out(TABLE, keys if gone is None else keys.unionByName(gone), KEY)
        change.append(TABLE, rows)
        change.commit(writer, epoch)
        return True
