"""Secret scans with an incremental blob ledger.

Every version of a file is addressed by the digest of its content. Only pairs of blob and rule
version that the ledger lacks are scanned, each once however many paths hold the blob; findings
are then joined back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import keyed_join, others, small, stored, table

FINDINGS = "array<struct<at:long, rank:int, kind:string, start:long, end:long>>"
LEDGER = f"blob string, rules string, findings {FINDINGS}"

#: Kinds in order of rank: pattern, the group that holds the secret, and the least characters it has.
#: Letters A-Z and a-z only; offsets are code points, the end exclusive.
RULES: tuple[tuple[str, re.Pattern, int, int], ...] = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+", re.A), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}", re.A), 0, 24),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", re.A), 0, 1),
    ("bearer", re.compile(r"(?:ghp|gho|ghs|xoxb|xoxp)[_-][A-Za-z0-9-]{16,}", re.A), 0, 1),
)
BASE = ("assign", "access", "hex")
RULES_VERSION = "2"


#: Most findings that are broadcast to the paths, and most digests of unseen blobs; beyond it both sides are shuffled.
BROADCAST_FINDINGS = 300_000


def find_secrets(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, rank, kind, start, end) of every finding, by start, then kind."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, kind, m.start(), m.end()))
    return sorted(found)


def _scan(blobs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        names = ("at", "rank", "kind", "start", "end")
        for batch in batches:
            found = [[dict(zip(names, x)) for x in find_secrets(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["blob", "findings"])

    return blobs.select("blob", "__text").mapInArrow(run, f"blob string, findings {FINDINGS}")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings of every version, and the ledger rows that this call added.

    versions: one row per path and version, with any columns. ledger: rows as LEDGER from earlier
    calls, or None. The first frame has all rows and columns of ``versions`` and blob (SHA-256 of
    the text) and findings (empty where nothing was found); the second is stored in the shared
    folder and is to be appended to the ledger.

    Null texts are empty blobs. Equal texts are one blob, repeated rows stay. Columns of
    ``versions`` named blob or findings give way. Whole texts are scanned.
    """
    columns = others(versions, ("blob", "findings"))
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blobs = versions.select(F.sha2(content, 256).alias("blob"), content.alias("__text"))
    if ledger is not None:
        # Digests alone tell the unseen blobs; no text that the ledger knows is moved.
        seen = ledger.filter(F.col("rules") == rules).select("blob").distinct()
        unseen = stored(blobs.select("blob").distinct().join(seen, "blob", "left_anti"), "secret-unseen")
        blobs = blobs.join(small(unseen, BROADCAST_FINDINGS), "blob", "left_semi")
    # One text for each blob: copies meet in the partial aggregate before they are dealt out.
    once = blobs.groupBy("blob").agg(F.first("__text").alias("__text"))
    added = stored(_scan(once).select("blob", F.lit(rules).alias("rules"), "findings"), "secret-ledger")
    known = added.select("blob", "findings")
    if ledger is not None:
        old = ledger.filter(F.col("rules") == rules).groupBy("blob").agg(F.first("findings").alias("findings"))
        known = known.unionByName(old)
    # Most blobs hold no secret; only the others meet their paths.
    hits = known.filter(F.size("findings") > 0)
    paths = versions.select(*columns, F.sha2(content, 256).alias("blob"))
    if hits.agg(F.coalesce(F.sum(F.size("findings")), F.lit(0))).first()[0] <= BROADCAST_FINDINGS:
        joined = paths.join(F.broadcast(hits), "blob", "left")
    else:
        # The most copied blob, or the empty one, is no one task's.
        rows = stored(paths.groupBy("blob").agg(F.count("*").alias("__rows")), "secret-copies")
        hits = rows.join(hits, "blob", "left").select("blob", "findings", "__rows")
        joined = keyed_join(paths, hits, ["blob"], "left", by=[c for c in columns if "map<" not in dict(versions.dtypes)[c]] or ["blob"])
    return joined.select(*columns, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")), added


def redact(text: str = "text", findings: str = "findings", mask: str = "[SECRET]"):
    """A column: the text with every found span replaced; overlapping spans become one mask."""
    merged = F.expr(
        f"aggregate(array_sort({findings}), cast(array() as array<struct<s:long,e:long>>), (acc, x) -> "
        "if(size(acc) > 0 and element_at(acc, -1).e >= x.start, "
        "concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).s as s, greatest(element_at(acc, -1).e, x.end) as e))), "
        "concat(acc, array(struct(x.start as s, x.end as e)))))"
    )
    cut = F.aggregate(
        merged, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, x: F.struct(F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.lit(mask)).alias("out"), x["e"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return F.when(F.size(findings) > 0, cut).otherwise(F.col(text))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions arrive in two batches, told apart by a hash of doc_id; the second is joined to the ledger of the first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    early = F.xxhash64("doc_id") < 0
    first, ledger = scan_versions(docs.filter(early))
    second, _ = scan_versions(docs.filter(~early), ledger)
    found = first.unionByName(second)
    span = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    ordered = F.array_sort("findings")
    base = F.filter(ordered, lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(F.array_join(F.transform(base, span), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(ordered, span), ",").alias("spans"),
    )
