"""Error codes of failed searches, from the kinds and messages of a chain of causes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codes.
CODES = {
    "unknown": 0, "open": 1, "text_search": 2, "ocr": 3, "native_library": 4, "cancelled": 5, "argument": 6,
    "encrypted": 7, "damaged": 8, "model_init": 9, "memory": 10, "index": 11, "cache": 12,
}
#: Words that tell a damaged or encrypted file, and a model that did not load (one of either list).
ENCRYPTED, DAMAGED = "password|encrypt", "corrupt|damaged|malformed|损坏"
MODEL, LOADING = "ocr|model|模型", "init|load|初始化|加载"


def classify(causes: Column, fallback: Column) -> Column:
    """The code of the first cause (struct of ``kind`` and ``message``, outermost first) that tells one; else ``fallback``."""

    def code(cause: Column) -> Column:
        said = lambda words: F.rlike(F.lower(F.coalesce(cause["message"], F.lit(""))), F.lit(words))
        return (
            F.when(cause["kind"] == "OutOfMemoryError", CODES["memory"])
            .when(cause["kind"] == "UnsatisfiedLinkError", CODES["native_library"])
            .when(said(ENCRYPTED), CODES["encrypted"])
            .when(said(DAMAGED), CODES["damaged"])
            .when(said(MODEL) & said(LOADING), CODES["model_init"])
        )

    told = F.filter(F.transform(causes, code), lambda c: c.isNotNull())
    return F.coalesce(F.try_element_at(told, F.lit(1)), fallback)
