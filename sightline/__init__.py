"""Media-evidence analytics on Spark.

DataFrame operators and jobs that turn machine-learning output about media
(labels, boxes and vectors per frame or window) into evidence tables and
answer similarity, identity and reprocessing questions over them.
"""

__version__ = "0.1.0"
