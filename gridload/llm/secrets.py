"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched for candidates. Three base kinds are findings by themselves:
``assign`` (a password-like name with a value), ``access`` (an access key id) and
``hex`` (a long hex run). A fourth, ``random``, is any long run of letters, digits and
``+/_-`` that mixes cases and digits and touches no base span; what decides there is
who else has it. All candidate values are hashed, and the corpus is asked how many
distinct repositories and owners hold each hash: a value that one owner alone has looks
live, one that several owners share is a copied example. ``random`` candidates count as
findings only where they look live; base spans always stay and carry the verdict.

Only rows with candidates take part in shuffles, and only as hashes. Copies of a value
within one repository are removed before the count, so a value in every row is cheap.

Defined results: null texts are empty; repeated rows (same id and text) get the same
findings; same ids with different texts are told apart; a null repository or owner
counts as one of its own; no rows give no rows. Positions are code points. Very long texts
are searched whole; the time follows the number of matches, but for the overlap test, which
compares each ``random`` candidate with the base spans of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.session import written

# Fixed patterns of the base kinds; group 2 of an assignment is its value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_CHARS = 8
MAX_OWNERS = 1
#: matches whose spans are appended to one array
BLOCK = 256

_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _spans(text: Column, kind: int, pattern: str, value_group: int = 0) -> Column:
    """All matches of a pattern with their places: lengths of pieces between matches.

    Arrays grow by copying, so matches are taken in blocks of ``BLOCK``: first the length
    of each block, then its spans from where it starts.
    """
    found, regex = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, regex, F.lit(value_group)) if value_group else found
    empty = F.array().cast(_SPAN)

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + m["gap"]
        end = begin + m["size"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def placed(block: Column) -> Column:
        """Spans of one block of pieces, which starts at ``at``."""
        return F.aggregate(
            block["pieces"], F.struct(block["at"].alias("at"), empty.alias("out")), step, lambda s: s["out"]
        )

    def in_blocks(pieces: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)))

    def with_starts(blocks: Column) -> Column:
        sizes = F.transform(
            blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda at, m: at + m["gap"] + m["size"])
        )
        starts = F.aggregate(
            sizes,
            F.array(F.lit(0).cast("bigint")),
            lambda found, size: F.concat(found, F.array(F.element_at(found, -1) + size)),
        )
        return F.zip_with(
            blocks, F.slice(starts, 1, F.size(blocks)),
            lambda block, at: F.struct(block.alias("pieces"), at.alias("at")),
        )

    pieces = F.transform(
        F.arrays_zip(
            F.transform(found, lambda m: F.length(m).cast("bigint")).alias("size"),
            F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.length(g).cast("bigint")).alias("gap"),
            values.alias("value"),
        ),
        lambda z: F.struct(z["size"].alias("size"), z["gap"].alias("gap"), z["value"].alias("value")),
    )
    # a lambda's variable is evaluated once, the expression behind it for every block
    blocks = F.get(F.transform(F.array(pieces), in_blocks), F.lit(0))
    blocks = F.get(F.transform(F.array(blocks), with_starts), F.lit(0))
    spans = F.flatten(F.transform(blocks, placed))
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def candidates(text: Column) -> tuple[Column, Column]:
    """Base spans, and the spans of ``random`` candidates before the overlap test."""
    assign = F.filter(_spans(text, 0, ASSIGN, 2), lambda s: F.length(s["value"]) >= ASSIGN_CHARS)
    base = F.array_sort(F.concat(assign, _spans(text, 1, ACCESS), _spans(text, 2, HEX)))
    mixed = F.filter(
        _spans(text, 3, RANDOM),
        lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"),
    )
    return base, mixed


def scan(
    docs: DataFrame,
    repository: Column,
    owner: Column,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """Findings per row: (doc_id, base, findings), both arrays by start, then kind.

    A finding has start, kind (number in ``KINDS``), end, value, owners, repositories
    and live (at most ``max_owners`` owners in the whole corpus).
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base, mixed = candidates(F.col("_text"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), whole.alias("_text"), repository.cast("string").alias("_repo"),
        owner.cast("string").alias("_owner"),
    )
    rows = rows.select(
        "doc_id", F.xxhash64("_text", F.length("_text")).alias("_row"), "_repo", "_owner",
        base.alias("base"), mixed.alias("_mixed"),
    )
    apart = F.filter(
        "_mixed",
        lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])),
    )
    rows = rows.select("doc_id", "_row", "_repo", "_owner", "base", F.array_sort(F.concat("base", apart)).alias("_all"))
    rows = written(rows, "candidates")  # texts are searched once
    found = rows.filter(F.size("_all") > 0).select(
        "doc_id", "_row", "_repo", "_owner", F.explode("_all").alias("span")
    ).distinct()
    found = found.withColumn("_hash", F.sha2(F.col("span")["value"], 256))
    held = found.select("_hash", "_repo", "_owner").distinct()
    counts = (
        held.groupBy("_hash", "_owner").agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    )
    judged = found.join(counts, "_hash").withColumn("live", F.col("owners") <= max_owners)
    judged = judged.filter((F.col("span")["kind"] < len(KINDS) - 1) | F.col("live"))
    finding = F.struct("span.start", "span.kind", "span.end", "span.value", "owners", "repositories", "live")
    each = judged.groupBy("doc_id", "_row").agg(F.array_sort(F.collect_set(finding)).alias("findings"))
    each = each.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_of"), "findings")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_of"))
    joined = rows.select("doc_id", "_row", "base").join(each, same, "left")
    nothing = F.array().cast(each.schema["findings"].dataType)
    return joined.select("doc_id", "base", F.coalesce("findings", nothing).alias("findings"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
