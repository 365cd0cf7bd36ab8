"""Language of texts by compression: the language whose dictionary makes a text smallest.

Training takes a bounded sample of labelled rows: of each language the `sample_docs` distinct texts with the smallest hash;
pieces from all over each, `dictionary_bytes` in all, are a raw-content zstandard dictionary. A text, as lower-case words of
letters, is cut into blocks of `BLOCK` bytes, all of them are compressed with each dictionary, and the sizes are added up, so that a long text is
judged as a whole and never outgrows the dictionaries. A margin between the two smallest sizes that is narrow, as a share of the
smallest, is a rejection.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .memory import lean

SAMPLE_DOCS = 80
DICTIONARY_BYTES = 112_000
MAX_LANGUAGES = 1000
BLOCK = 8192
LEVEL = 5
NO_LETTERS = re.compile(r"[\W\d_]+")
#: Pieces that a text longer than its share of the dictionary gives.
PIECES = 4
#: A margin below this share of the smallest size is no decision.
LEAST_SHARE = 0.03
UNKNOWN = "und"
PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.LongType()), T.StructField("rejected", T.BooleanType())])


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Each language's dictionary, from rows of docs (doc_id, text, lang) with an id, a text and a language that are not held out.

    Counts go over all distinct texts; by them, each language gets a bound on the hash below which some three times the wanted
    texts lie, so that only these reach the last step. At most MAX_LANGUAGES languages are told apart; more raise an error.
    """
    lang, doc = F.col("lang").cast("string"), F.col("doc_id").cast("long")
    rows = docs.where((F.length("text") > 0) & F.col("lang").isNotNull() & doc.isNotNull() & ~held_out(doc)).select(lang.alias("lang"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    counts = {r.lang: r.n for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    each = max(1, dictionary_bytes // sample_docs)
    below = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(2**63 - 1, 2**64 * 3 * sample_docs // n - 2**63)).cast("long"))))
    few = rows.where(F.col("h") <= below[F.col("lang")]).groupBy("lang", "h").agg(F.min(_pieces(F.col("text"), each)).alias("text"))
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= sample_docs)
    texts: dict[str, list] = {}
    for r in sorted(few.select("lang", "k", "text").collect()):
        texts.setdefault(r.lang, []).append(plain(r.text).split())
    # Passages that several languages' texts share (notices, quotations) tell nothing of a language; those within one stay once.
    seen = Counter(x for v in texts.values() for x in {tuple(w[i : i + 4]) for w in v for i in range(len(w) - 3)})
    return {k: _content(_own(v, seen), dictionary_bytes) for k, v in sorted(texts.items())}


def _pieces(text: Column, size: int) -> Column:
    """A text of up to size characters, or pieces from its beginning to its end that are as long together."""
    part = max(1, size // PIECES)
    gap = (F.length(text) - part) / F.lit(PIECES - 1)
    pieces = [F.substring(text, F.floor(gap * i).cast("int") + 1, F.lit(part)) for i in range(PIECES)]
    return F.when(F.length(text) <= size, text).otherwise(F.concat_ws(" ", *pieces))


def plain(text: str) -> str:
    """Lower case, and one space for each run of what is no letter."""
    return NO_LETTERS.sub(" ", text.lower())


def _own(texts: list[list[str]], seen: Counter) -> list[str]:
    """The texts of one language without what others share, and with only the first copy of what they share themselves."""
    had: set[tuple] = set()
    out = []
    for words in texts:
        grams = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
        gone = {j for i, g in enumerate(grams) if seen[g] > 1 or g in had for j in range(i, i + 4)}
        had.update(grams)
        out.append(" ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def _content(texts: list[str], size: int) -> bytes:
    """The texts one after the other, repeated where they are too few for a dictionary of 1 KB."""
    whole = f" {' '.join(texts)} ".encode()[:size]
    return whole * -(-1024 // len(whole)) if len(whole) < 1024 else whole


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.coders = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> list[int]:
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, int, bool]:
        """Language, score, margin in bytes, and whether the margin is too narrow to be trusted."""
        raw = f"{plain(text or '')} "
        if not self.names or not any(map(str.isalpha, raw)):
            return UNKNOWN, 0.0, 0, True
        sizes = self.sizes(raw.encode())
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.names[i]))
        best = sizes[order[0]]
        margin = sizes[order[1]] - best if len(order) > 1 else best
        score = 1.0 / sum(2.0 ** -min(60, x - best) for x in sizes)
        return self.names[order[0]], score, margin, margin < LEAST_SHARE * best


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """docs with lang_pred, score, margin and rejected (columns of these names are replaced), by the whole `text` alone.

    `und` where the text is null or has no letter, which is always rejected. Equal sizes go to the first name in order.
    With no dictionaries all are `und`. Equal texts get equal values.
    """
    names = [f.name for f in PREDICTED]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most MAX_LANGUAGES * DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for whole in batches:
            for k in range(0, len(whole), 1000):
                batch = whole.slice(k, 1000)
                found = list(zip(*map(model.predict, batch.column("text").cast(pa.string()).to_pylist()), strict=True))
                new = [pa.array(c, type=t) for c, t in zip(found, (pa.string(), pa.float64(), pa.int64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *PREDICTED.fields]))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
