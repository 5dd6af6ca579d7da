"""Language identification by language-bitmask n-gram filters.

Of every language the n-grams that are frequent in its texts go into a Bloom filter. The filters of
all languages share their hash functions and lie side by side, bit-sliced: a slot holds one bit for
each language. The slots of an n-gram, combined by AND, are all languages that contain it. A text's
n-grams are counted for each language, corrected for the false positives that the filter's fill
gives, and the greatest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.bpe import slices
from flowgrid.llm.common import materialise
from flowgrid.llm.shingles import mix

#: Characters of an n-gram, and hash functions.
GRAM = 4
HASHES = 3
#: Least share of an n-gram in its language's text: no language has more than 100,000 such ones.
LEAST_RATE = 1e-5
#: Least share in relation to the language that has the n-gram most often: some texts under a wrong
#: label don't teach a language another one's n-grams.
LEAST_RATIO = 0.1
#: Slots of the filter, 8 MB for 64 languages, whatever the size of the corpus.
SLOT_BITS = 20
#: Languages up to which the filter has a proven size, 128 MB.
MOST_LANGUAGES = 1024
#: Characters that are held as numbers at a time.
CHUNK = 1 << 20
#: Documents with this remainder of their id's CRC are held out.
HELD_OUT = 2
PARTS = 4

_SPACE = 32
_SALTS = [mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(16)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_hashes(text: str, size: int = GRAM, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of a whole text, part by part.

    Letters are in lower case and anything between them is one space, also before the first and after
    the last. A text without letters has none; one with fewer characters has one, filled with spaces.
    """
    letter, tail, any_, given = _letters(), np.array([_SPACE], np.uint32), False, False
    for at in range(0, len(text), chunk):
        points = np.frombuffer(text[at : at + chunk].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(letter[points], points, _SPACE)
        points = np.concatenate((tail, points))
        keep = points != _SPACE
        keep[1:] |= points[:-1] != _SPACE
        keep[: len(tail)] = True
        points = points[keep]
        any_ = any_ or bool((points != _SPACE).any())
        if at + chunk >= len(text) and any_:
            fill = max(int(points[-1] != _SPACE), 0 if given else size - len(points))
            points = np.concatenate((points, np.full(fill, _SPACE, np.uint32)))
        if len(points) >= size:
            given = True
            yield _hashed(points, size)
        tail = points[max(0, len(points) - size + 1) :]


def _hashed(points: np.ndarray, size: int) -> np.ndarray:
    n = len(points) - size + 1
    sums = np.zeros(n, np.uint64)
    for k in range(size):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n]
    return mix(sums)


def slots_of(grams: np.ndarray, hashes: int = HASHES, bits: int = SLOT_BITS) -> list[np.ndarray]:
    """The slots of each n-gram, one array for each hash function."""
    return [(mix(grams * _SALTS[k]) >> np.uint64(64 - bits)).astype(np.int64) for k in range(hashes)]


def gram_counts(docs: DataFrame, lang: str, text: str, size: int = GRAM) -> DataFrame:
    """(lang, gram, n): n-grams of the texts of each language, counted in each task, then summed."""
    given = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch):
                held: dict[str, list[np.ndarray]] = {}
                for name, t in zip(small.column(0).to_pylist(), small.column(1), strict=True):
                    for part in gram_hashes(t.as_py(), size):
                        held.setdefault(name, []).append(part)
                for name, parts in held.items():
                    grams, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return given.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageFilter:
    """Languages, those with most text first, and the slots that aren't empty: (slot, word of 64
    languages, their bits)."""

    languages: list[str]
    slots: np.ndarray
    words: np.ndarray
    bits: np.ndarray
    hashes: int = HASHES
    slot_bits: int = SLOT_BITS
    size: int = GRAM

    def dense(self) -> np.ndarray:
        """A row a slot, a column for each 64 languages."""
        out = np.zeros((1 << self.slot_bits, max(1, -(-len(self.languages) // 64))), np.uint64)
        out[self.slots, self.words] = self.bits.view(np.uint64)
        return out

    def false_positives(self, table: np.ndarray) -> np.ndarray:
        """For each language the probability that an n-gram it lacks seems to be there."""
        return np.array([np.count_nonzero(_bit(table, k)) / len(table) for k in range(len(self.languages))]) ** self.hashes

    def containing(self, table: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The bitmask of all languages that contain each n-gram."""
        first, *rest = slots_of(grams, self.hashes, self.slot_bits)
        found = table[first]
        for s in rest:
            found &= table[s]
        return found


def _bit(masks: np.ndarray, language: int) -> np.ndarray:
    return masks[:, language // 64] >> np.uint64(language % 64) & np.uint64(1)


def fit_languages(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = GRAM, hashes: int = HASHES, slot_bits: int = SLOT_BITS, least_rate: float = LEAST_RATE, least_ratio: float = LEAST_RATIO) -> LanguageFilter:
    """The filter of the labelled texts. N-grams are counted over all of them; what comes to the driver
    are the languages and the filter's slots, whose number is a parameter."""
    counts = materialise(gram_counts(docs, lang, text, size), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    if totals.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [r["lang"] for r in totals.orderBy(F.desc("total"), "lang").collect()]
    numbered = docs.sparkSession.createDataFrame(list(enumerate(languages)), "no long, name string")
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total")).filter(F.col("rate") >= least_rate)
    rates = rates.join(F.broadcast(numbered), F.col("lang") == F.col("name")).groupBy("gram").agg(F.collect_list(F.struct("no", "rate")).alias("held"), F.max("rate").alias("most"))
    held = rates.select("gram", F.explode(F.filter("held", lambda x: x["rate"] >= least_ratio * F.col("most"))).alias("x")).select("gram", "x.no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slots in slots_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), hashes, slot_bits):
                yield pa.RecordBatch.from_arrays([pa.array(slots), batch.column(1)], names=["slot", "no"])

    taken = held.mapInArrow(run, "slot long, no long").groupBy("slot", F.shiftright("no", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(no & 63 as int)))").alias("bits")).toArrow()
    return LanguageFilter(languages, *(taken.column(c).to_numpy() for c in ("slot", "word", "bits")), hashes, slot_bits, size)


def decide(counts: np.ndarray, n: np.ndarray, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of counts by language, of n n-grams each: the language, and its share of what all
    languages have, after those expected by mistake are taken off. Equal ones go to the first."""
    sure = np.clip((counts - n[:, None] * wrong) / np.maximum(1 - wrong, 1e-9), 0, None)
    best = sure.argmax(1)
    total = sure.sum(1)
    return best, np.divide(sure[np.arange(len(sure)), best], total, out=np.zeros(len(sure)), where=total > 0)


def predict_languages(docs: DataFrame, learned: LanguageFilter, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """Columns ``keep`` with lang_pred and score of every whole text."""
    names = list(keep)
    given = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text).cast("string").alias("_text_in"))
    n_languages = len(learned.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = learned.dense()
        wrong = learned.false_positives(table)
        for batch in batches:
            for small in slices(batch):
                n, counts = np.zeros(small.num_rows, np.int64), np.zeros((small.num_rows, max(1, n_languages)), np.int64)
                for k, t in enumerate(small.column(len(names))):
                    for grams in gram_hashes(t.as_py() or "", learned.size):
                        n[k] += len(grams)
                        found = learned.containing(table, grams)
                        for language in range(n_languages):
                            counts[k, language] += np.count_nonzero(_bit(found, language))
                best, score = decide(counts, n, wrong if n_languages else np.zeros(1))
                said = [learned.languages[b] if some and n_languages else "und" for b, some in zip(best.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*small.columns[:-1], pa.array(said, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: str) -> Column:
    """Whether a document is kept from learning: by the CRC of its id as text, of which a null one has none."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % PARTS == HELD_OUT


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``, learnt from the labelled rows that
    aren't held out.

    lang_pred is ``und`` and score 0 for null texts and texts without letters, and for all if no row
    teaches a language. A text whose n-grams no language has gets the language with most text and
    score 0. Rows without a label teach nothing; repeated rows teach as often as they occur; a
    null id isn't held out. An empty table gives no rows.
    """
    learned = fit_languages(docs.filter(~held_out(doc_id)), lang, text)
    return predict_languages(docs, learned, {"doc_id": F.col(doc_id).cast("long"), "held_out": held_out(doc_id)}, text)
