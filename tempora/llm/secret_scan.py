"""Secrets in texts, judged by who else has them.

Each task finds candidates in whole texts: assignments, access keys and hex runs, and beside them mixed runs, passwords in
addresses and private key blocks. A candidate's value leaves the task only as a 128-bit digest. Over the whole corpus Spark counts the
distinct owners of a digest and the distinct repositories of each owner; both counts are reduced by
aggregates with map-side combine, so a value that stands in a third of all rows is added up where it is read. A value
that many owners have is an example that was copied around; one that few have and that looks random is a live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import when_small
from tempora.session import stage

#: Fixed patterns: kind, expression, group that holds the value, characters it needs. Their matches are always spans.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: Further kinds, in the order of their names in the spans; a match is a span only if its value belongs to few owners.
ADDED = (
    ("address", re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{6,128})@"), 1, 6),
    ("mixed", re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}"), 0, 20),
    ("private", re.compile(r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END"), 2, 64),
)
KINDS = [k for k, *_ in (*BASE, *ADDED)]
#: Values that this many owners or fewer have are their own; with more than one owner, that many repositories are too many.
MAX_OWNERS = 2
MAX_REPOSITORIES = 50
#: Bits a character that a random value has at least; words and repeated characters have fewer.
MIN_ENTROPY = 3.0
_DULL = re.compile(r"example|changeme|placeholder|your[_-]?|x{4}|\*{3}|(.)\1{5}|1234567|abcdefg", re.I)

_SPAN = "kind string, start int, end int, digest binary, random boolean, base boolean"
_CANDIDATES = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary()), ("random", pa.bool_()), ("base", pa.bool_())])
)


def entropy(value: str) -> float:
    """Bits a character of the value's own character counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    return len(value) >= 12 and entropy(value) >= MIN_ENTROPY and not _DULL.search(value)


def is_mixed(value: str) -> bool:
    """Letters and at least two digits, in no part that is just a word or a number."""
    return sum(c.isdigit() for c in value) >= 2 and any(c.isalpha() for c in value) and max(map(len, re.split(r"[+/_=-]", value))) >= 16


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def candidates(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, value, base) by start, then kind. Added ones never overlap base ones or each other."""
    found = []
    for kind, pattern, group, least in BASE:
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((kind, m.start(), m.end(), m[group], True))
    starts, ends = _merged([(s, e) for _, s, e, _, _ in found])
    for kind, pattern, group, least in (ADDED[0], ADDED[2], ADDED[1]):
        more = []
        for m in pattern.finditer(text):
            value, (s, e) = m[group], m.span()
            behind = bisect_right(ends, s)
            if len(value) >= least and (kind != "mixed" or is_mixed(value)) and not (behind < len(starts) and starts[behind] < e):
                more.append((kind, s, e, value, False))
        found += more
        starts, ends = _merged([*zip(starts, ends, strict=True), *((s, e) for _, s, e, _, _ in more)])
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            column.append(
                [
                    {"kind": k, "start": s, "end": e, "digest": hashlib.blake2b(v.encode(), digest_size=16).digest(), "random": looks_random(v), "base": base}
                    for k, s, e, v, base in candidates(text or "")
                ]
            )
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(column, _CANDIDATES)], [*batch.schema.names[:-1], "spans"])


def ownership(found: DataFrame) -> DataFrame:
    """``found(digest, owner, repository)`` -> digest, n_owners, n_repositories; null owners are one owner, null repositories one of their owner's."""
    each = found.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = each.groupBy("digest", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def verdict(n_owners: Column, n_repositories: Column, random: Column) -> Column:
    """``copied``: many have it; ``dull``: a word or placeholder; ``owned``: a live-looking value of few."""
    copied = (n_owners > MAX_OWNERS) | ((n_owners > 1) & (n_repositories > MAX_REPOSITORIES))
    return F.when(copied, "copied").when(random, "owned").otherwise("dull")


def scan(docs: DataFrame, keep: list[str], owner: Column, repository: Column, text: str = "text") -> DataFrame:
    """Every document as ``row`` (the ``keep`` columns) with ``spans`` by start, then kind:
    (start, rank of the kind, end, kind, digest, n_owners, n_repositories, verdict).

    Base kinds are spans whatever their verdict, the others only if it is ``owned``. Offsets are code points, the end is
    exclusive. Null and empty texts have no span. Repeated rows are scanned one by one but count once for their owner and
    repository. Columns that are neither kept nor named don't matter, whatever their names.
    """
    rows = docs.select(F.struct(*keep).alias("row"), owner.alias("owner"), repository.alias("repository"), F.col(text).alias("_text"))
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("row", "owner", "repository"))
    scanned = rows.mapInArrow(_scan, f"{schema}, spans array<struct<{_SPAN.replace(' ', ':').replace(',:', ',')}>>")
    scanned = stage(scanned.withColumn("uid", F.monotonically_increasing_id()), "scanned")
    each = scanned.filter(F.size("spans") > 0).select("uid", "owner", "repository", F.explode("spans").alias("s")).select("uid", "owner", "repository", "s.*")
    owned = when_small(stage(ownership(each), "owned"), 64)
    judged = each.join(owned, "digest").withColumn("verdict", verdict(F.col("n_owners"), F.col("n_repositories"), F.col("random")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct("start", rank.alias("rank"), "end", "kind", "digest", "n_owners", "n_repositories", "verdict")
    spans = judged.filter(F.col("base") | (F.col("verdict") == "owned")).groupBy("uid").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return scanned.select("uid", "row").join(spans, "uid", "left").select("row", F.coalesce("spans", empty).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
