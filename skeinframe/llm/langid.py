"""Language identification by compression.

Each language has a raw-content dictionary: some of its texts. A text is compressed
with every language's dictionary by zstandard, and the language whose dictionary
leaves the fewest bytes wins. Where the best two are close, the choice is flagged as
rejected: `confident` is false.

The smallest size decides. Only texts whose smallest sizes are equal (very short
ones) are told apart by how many of their bytes lie in words that the dictionary
holds, then by the language's name. A text is compressed once a language, so time and
the dictionaries' memory (DICTIONARY_BYTES each) are linear in the number of languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.llm import _common
from skeinframe.llm.toxic import remainder

#: Texts of a language that may be learned from, at most: those with the smallest hash of the id; bytes of its dictionary.
SAMPLE, DICTIONARY_BYTES = 200, 1 << 17
LEVEL = 6
#: Bytes saved, as a share of the best size, below which a choice is rejected.
MARGIN = 0.01
_GAP = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def plain(text: str) -> str:
    """The whole text's words in lower case with single spaces between: what is compressed, and what dictionaries hold."""
    return _GAP.sub(" ", text.lower())


class Model:
    """dictionaries: bytes by language."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names = sorted(dictionaries)
        self.compressors, self.words = [], []
        for name in self.names:
            data = zstandard.ZstdCompressionDict(dictionaries[name] or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False))
            self.words.append(frozenset(dictionaries[name].decode("utf-8", "ignore").split()))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, confident)."""
        text = plain(text or "").strip()
        if not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        raw = text.encode()
        sizes = [len(c.compress(raw)) for c in self.compressors]
        at = sizes.index(min(sizes))
        if sizes.count(sizes[at]) > 1:
            found = text.split()
            at = max((i for i, n in enumerate(sizes) if n == sizes[at]), key=lambda i: (sum(len(w) for w in found if w in self.words[i]), -i))
        others = [n for i, n in enumerate(sizes) if i != at]
        gap = (min(others) - sizes[at]) / max(sizes[at], 1) if others else 1.0
        return self.names[at], min(1.0, max(0.0, 0.5 + gap)), gap >= MARGIN


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries from at most `sample` texts of each language, none of them with crc32(id as text) mod folds = held.

    Every language of a row with an id, a text that isn't empty and a lang that isn't null is learned, however rare. Rows that
    share an id and a language are one: their smallest text. An empty table gives no dictionaries.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.length(F.col(text_col).cast("string")).alias("n"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.col("n") > 0) & (remainder(F.col("id"), folds) != held))
    # the limit on the rank is applied within each task before the shuffle
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = _common.settle(rows.withColumn("rank", rank).where(F.col("rank") <= sample).select("id", "lang", "rank").dropDuplicates(["id", "lang"]), "langid-sample")
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), ["id", "lang"])
    texts = texts.select("lang", "rank", "t").groupBy("lang", "rank").agg(F.min("t").alias("t"))
    # as many texts, from the first rank on, as fill the dictionary: size bytes a language reach the driver, and one text over
    upto = F.sum(F.octet_length("t")).over(Window.partitionBy("lang").orderBy("rank")) - F.octet_length("t")
    got = texts.withColumn("upto", upto).where(F.col("upto") < size).orderBy("lang", "rank").select("lang", "t").toArrow()
    parts: dict[str, list[str]] = {}
    for lang, text in zip(got.column("lang").to_pylist(), got.column("t").to_pylist(), strict=True):
        parts.setdefault(lang, []).append(text)
    return {lang: plain(" ".join(texts)).encode()[:size] for lang, texts in parts.items()}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2) -> DataFrame:
    """A row per document: the id, held_out (crc32(id as text) mod folds = held), lang_pred, score, confident.

    score is 0.5 and the share of bytes by which the best beats the next, at most 1. Cases: null texts and those without a
    letter are `und` with score 0, as are all where no language was learned; repeated rows get the same; a null id is held
    out of nothing; an empty table gives no rows; other columns are ignored.
    """
    _common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            names, scores, sure = zip(*map(model.predict, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], ["id", "lang_pred", "score", "confident"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(predicted, f"id {kind}, lang_pred string, score double, confident boolean")
    held_out = F.coalesce(remainder(F.col("id"), folds) == held, F.lit(False))
    return out.select(F.col("id").alias(id_col), held_out.alias("held_out"), "lang_pred", "score", "confident")
