"""Secret scans: strong patterns by themselves, weak ones only next to what completes them.

A credential often comes in parts: an access identifier, a secret, and the endpoint that takes
them. Assigned values, access keys and long hexadecimal runs count by themselves. Identifiers,
mixed runs of characters and endpoints are too common alone; each is reported only where its
complement lies within ``reach`` code points: an identifier needs a secret, a secret an
identifier, an endpoint both. That is an interval join of the parts of one text, extended by the
reach, evaluated as a sweep: per text the parts are sorted by their start, and running bounds of
each role give the nearest before and after. Its cost is n log n in the parts, and no pairs of
parts are formed.

Only DataFrame functions are used. Defined results: a null text has no spans, and an empty one none;
a text of any length is scanned whole; equal rows get equal results, each its own row, under null
ids too; texts under one id that differ are scanned apart; of kinds that start at one place the one
listed first comes first; positions are code points; an empty table gives an empty result; columns
other than doc_id and text give way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import let
from evidentia.plans.staging import staged

#: Fixed by the contract. Kinds are listed in the order in which equal starts are reported.
ASSIGN = r"""(?=[AaPpSsTt])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of 24 and more are the same as runs of any length of which the shorter ones are dropped.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Parts that count only with their complement.
KEY_ID = r"""(?:ASIA|AROA|AIDA)[A-Z0-9]{8,}|(?i:client_?id|user_?name|account|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
SECRET = r"(?<![A-Za-z0-9/+_-])[A-Za-z0-9/+_-]{20,}+"
ENDPOINT = r"""(?i:https?|wss?|ftps?|jdbc|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+|(?i:host|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}"""

KINDS = ("assign", "access", "hex", "key_id", "secret", "endpoint")
BASE = KINDS[:3]
#: What a kind is in a credential, and what a weak kind needs near it.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "key_id": "id", "secret": "secret", "endpoint": "endpoint"}
NEEDS = {"key_id": ("secret",), "secret": ("id",), "endpoint": ("id", "secret")}
REACH = 300

FOUND = "array<struct<kind:int,i:int,gap:int,size:int,valid:boolean>>"


def _finds(text: Column, kind: str, pattern: str, valid: Callable[[Column, Column], Column]) -> Column:
    """All leftmost matches: for each the characters since the last one, its own, and if it counts.

    The text between the matches comes from a split by the same pattern, done only where there
    are matches."""

    def measured(hits: Column) -> Column:
        row = lambda gaps: F.transform(hits, lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(x).alias("size"), valid(x, i).alias("valid")))
        return F.when(F.size(hits) == 0, F.array().cast(FOUND)).otherwise(let(F.split(text, pattern, -1), row).cast(FOUND))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), measured)


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, the hash that tells texts of one id apart, and the matches of every kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    always = lambda x, i: F.lit(True)
    mixed = lambda x, i: x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]")
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assigned = let(values, lambda v: _finds(text, "assign", ASSIGN, lambda x, i: F.length(F.get(v, i)) >= 6))
    # What a pattern cannot do without is looked for first; that is far cheaper than the pattern.
    only_if = lambda needed, finds: F.when(needed, finds).otherwise(F.array().cast(FOUND))
    marked = text.contains(":") | text.contains("=")
    long_run = text.rlike(SECRET)  # a run of 24 hexadecimal digits lies in such a run too
    found = F.concat(
        only_if(marked, assigned),
        only_if(text.contains("AKIA"), _finds(text, "access", ACCESS, lambda x, i: F.length(x) >= 20)),
        only_if(long_run, _finds(text, "hex", HEX, always)),
        only_if(marked | text.rlike("ASIA|AROA|AIDA"), _finds(text, "key_id", KEY_ID, always)),
        only_if(long_run, _finds(text, "secret", SECRET, mixed)),
        only_if(marked, _finds(text, "endpoint", ENDPOINT, always)),
    )
    return documents.select("doc_id", F.xxhash64(text).alias("text_hash"), found.alias("found"))


def linked_spans(found: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, text_hash, kind, start, stop of each span that is reported."""
    text_of = ["doc_id", "text_hash"]
    one = found.filter(F.size("found") > 0).groupBy(*text_of).agg(F.first("found").alias("found"))
    rows = one.select(*text_of, F.explode("found").alias("m")).select(*text_of, "m.*")
    walked = Window.partitionBy(*text_of, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(walked)
    parts = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size")).filter("valid")

    names = F.array(*[F.lit(k) for k in KINDS])
    roles = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    parts = parts.withColumn("role", F.get(roles, F.col("kind"))).withColumn("base", F.col("kind") < len(BASE))
    order = Window.partitionBy(*text_of).orderBy("start", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    bounds = {}
    for role in ("id", "secret"):
        is_it = F.col("role") == role
        bounds[f"{role}_before"] = F.max(F.when(is_it, F.col("stop"))).over(before)
        bounds[f"{role}_after"] = F.min(F.when(is_it, F.col("start"))).over(after)
    bounds["base_before"] = F.max(F.when(F.col("base"), F.col("stop"))).over(before)
    bounds["base_after"] = F.min(F.when(F.col("base"), F.col("start"))).over(after)
    swept = parts.withColumns(bounds)

    near = lambda role: F.coalesce(F.col("start") - F.col(f"{role}_before") <= reach, F.lit(False)) | F.coalesce(F.col(f"{role}_after") - F.col("stop") <= reach, F.lit(False))
    covered = F.coalesce(F.col("base_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("base_after") < F.col("stop"), F.lit(False))
    completed = F.lit(False)
    for kind, needs in NEEDS.items():
        all_near = F.lit(True)
        for role in needs:
            all_near = all_near & near(role)
        completed = completed | ((F.col("kind") == KINDS.index(kind)) & all_near)
    return swept.filter(F.col("base") | (completed & ~covered)).select(*text_of, "kind", F.get(names, F.col("kind")).alias("name"), "start", "stop")


def secret_scan(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """Every document with ``spans``: array of (start, kind, name, stop), sorted."""
    found = staged(candidates(documents), "secret_candidates")
    spans = linked_spans(found, reach).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "name", "stop"))).alias("spans"))
    base, own = found.select("doc_id", "text_hash").alias("d"), spans.alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return base.join(own, same, "left").select("d.doc_id", F.coalesce("s.spans", none).alias("spans"))
