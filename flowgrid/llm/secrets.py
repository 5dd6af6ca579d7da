"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every whole text. Hashes of their values are counted over the corpus by
distinct repositories and owners: what several owners hold is a widely copied example; what one or
two hold, in however many of their repositories and copies, and looks random, is taken for a live
credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgrid.llm.bpe import slices
from flowgrid.llm.common import materialise

# The base patterns and the least length of each kind's secret.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "hosted", "chat", "jwt", "pem")
# Formats of issued credentials that the method adds to the base.
ADDED = {
    "hosted": (re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), "gh"),
    "chat": (re.compile(r"xox[abeoprs]-[A-Za-z0-9-]{10,}"), "xox"),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), "eyJ"),
    "pem": (re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"), "-----BEGIN"),
}
# Parts of values that documentation uses as stand-ins.
STAND_INS = ("example", "sample", "dummy", "changeme", "placeholder", "password", "your", "xxxx", "test", "0123456789", "123456789", "abcdef")

#: Owners from which a value counts as copied widely.
MANY_OWNERS = 3
LEAST_ENTROPY = 2.8


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of all candidates, by start and kind, in code points."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            out.append((m.start(), m.end(), "assign", m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= LEAST["access"]:
                out.append((m.start(), m.end(), "access", m[0]))
    for m in _LONG_HEX.finditer(text):
        out.append((m.start(), m.end(), "hex", m[0]))
    for kind, (pattern, sign) in ADDED.items():
        if sign in text:
            out += [(m.start(), m.end(), kind, m[0]) for m in pattern.finditer(text)]
    out.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return out


#: A maximal run of hex digits is one match of HEX, so asking for its length at once finds the same.
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])


def looks_live(value: str) -> bool:
    """Random enough for an issued credential and no known stand-in."""
    low = value.lower()
    if value.isdigit() or any(s in low for s in STAND_INS):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= LEAST_ENTROPY


_CANDIDATE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value_hash", T.BinaryType()), T.StructField("looks_live", T.BooleanType())])


def scan_secrets(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """Columns ``keep`` with each text's base counts, base digest, spans and candidates."""
    names = list(keep)
    given = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text).cast("string").alias("_text_in"))
    schema = T.StructType(
        [*[given.schema[k] for k in names], *[T.StructField(k, T.LongType()) for k in ("n_assign", "n_access", "n_hex")], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("candidates", T.ArrayType(_CANDIDATE))]
    )
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_hash", pa.binary()), ("looks_live", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch):
                counts: dict[str, list[int]] = {"assign": [], "access": [], "hex": []}
                base, spans, candidates = [], [], []
                for t in small.column(len(names)):
                    found = find(t.as_py() or "")
                    kinds = Counter(x[2] for x in found)
                    for k, v in counts.items():
                        v.append(kinds[k])
                    base.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k, _ in found if k in counts).encode()).hexdigest())
                    spans.append(",".join(f"{k}:{a}:{b}" for a, b, k, _ in found))
                    candidates.append([{"kind": k, "start": a, "end": b, "value_hash": hashlib.blake2b(v.encode(), digest_size=16).digest(), "looks_live": looks_live(v)} for a, b, k, v in found])
                yield pa.RecordBatch.from_arrays([*[small.column(k) for k in range(len(names))], *[pa.array(v, pa.int64()) for v in counts.values()], pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(candidates, kind_type)], names=schema.names)

    return given.mapInArrow(run, schema)


def ownership(candidates: DataFrame, many_owners: int = MANY_OWNERS) -> DataFrame:
    """``value_hash`` with its distinct repositories and owners over the corpus, and whether so many
    owners make it a widely copied example. An owner's own copies never do: a leaked key spreads over
    its owner's repositories by itself. One row for each (value, owner, repository) first, so that a
    value which a third of all rows hold doesn't meet in one task."""
    held = candidates.groupBy("value_hash", "_owner", "_repo").agg(F.lit(1).alias("_"))
    counted = held.groupBy("value_hash").agg(F.countDistinct("_owner").alias("n_owners"), F.countDistinct("_repo").alias("n_repos"))
    return counted.withColumn("is_example", F.col("n_owners") >= many_owners)


def _verdicts(scan: DataFrame, many_owners: int) -> DataFrame:
    """One row per candidate of ``scan`` (columns ``_uid``, ``_owner``, ``_repo``)."""
    each = scan.select("_uid", "_owner", "_repo", F.explode("candidates").alias("c")).select("_uid", "_owner", "_repo", "c.*")
    return each.drop("_owner", "_repo").join(materialise(ownership(each, many_owners), "owners", reduced=True), "value_hash").withColumn("is_live", F.col("looks_live") & ~F.col("is_example"))


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id", many_owners: int = MANY_OWNERS) -> DataFrame:
    """Secrets of every whole text with the corpus's verdict on them.

    Returns doc_id, the base counts and digest, ``spans`` (base and added, kind:start:end),
    ``n_examples``, ``n_live``, ``live_spans``, and ``most_owners`` and ``most_repos``: the greatest
    counts of distinct owners and repositories that hold one of its values. Owners alone decide;
    repositories are a report. A null or empty text has no spans. A null owner or repository isn't
    counted as one, so a value without any owner is nobody's example. Repeated rows are scanned each, but one owner counts once
    for a value. An empty table gives no rows.
    """
    keep = {"doc_id": F.col(doc_id), "_owner": F.col(owner), "_repo": F.col(repo), "_uid": F.monotonically_increasing_id()}
    scan = materialise(scan_secrets(docs, keep, text), "secrets")
    verdicts = _verdicts(scan.filter(F.size("candidates") > 0), many_owners)
    span = F.struct("start", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("o"), "end", "kind")
    live = verdicts.groupBy("_uid").agg(
        F.count_if("is_example").alias("n_examples"),
        F.count_if("is_live").alias("n_live"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("most_repos"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("is_live"), span))), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",").alias("live_spans"),
    )
    return scan.join(live, "_uid", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.coalesce("n_examples", F.lit(0)).alias("n_examples"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("live_spans", F.lit("")).alias("live_spans"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("most_owners", "most_repos")])


def redact_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", many_owners: int = MANY_OWNERS, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, with its columns, where every live secret is replaced by ``mark``.

    Verdicts depend on values alone, so spans are joined to texts by the texts' SHA-256 and equal
    texts get equal ones. Widely copied examples stay. Null and empty texts stay as they are.
    """
    keep = {"_key": F.sha2(F.col(text).cast("binary"), 256), "_owner": F.col(owner), "_repo": F.col(repo), "_uid": F.monotonically_increasing_id()}
    scan = materialise(scan_secrets(docs, keep, text).filter(F.size("candidates") > 0), "secrets")
    live = _verdicts(scan, many_owners).filter("is_live").groupBy("_uid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    by_text = scan.select("_uid", "_key").join(live, "_uid").groupBy(F.col("_key").alias("_live_key")).agg(F.min("_spans").alias("_spans"))
    names = docs.columns
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), keep["_key"].alias("_key")).join(by_text, F.col("_key") == F.col("_live_key"), "left")

    # From the last span to the first, so that earlier places stay valid.
    merged = F.aggregate(
        F.col("_spans"),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["end"] <= acc["at"], acc["out"])
            .when(s["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(F.col("_row")[text], acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
            .alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("_row")[text], acc["at"].cast("int") + 1, F.lit(2**31 - 1))),
    )
    return joined.select(F.when(F.col("_spans").isNull(), F.col("_row")).otherwise(F.col("_row").withField(text, merged)).alias("_row")).select("_row.*")
