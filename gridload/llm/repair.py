r"""Repair of conversation structure by a shortest path over big-integer weights.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Edits turn it into
one: keep a row (cost 0), rerole it to user or assistant (2), delete it (3), insert an empty
user or assistant row anywhere (2); a truncated row that stays costs 1 more, blank and repeated
rows must go. Of all cheapest edit lists the one whose initials ``DIKR`` (the audit) come first
in ASCII order wins.

Weights. The nodes of the graph are (rows left, state); a path's weight is one integer: its
high digits are the cost, below stand a fixed number of octal digits, one per letter of the
audit from the left, zeros at the end. Putting an edit before a path adds its cost, moves the
letters one place to the right and writes its own letter in the first: integers then order
paths by cost, equal costs by audit (an audit that ends earlier comes first). The plain minimum of integers
decides every step, and the edits are read back from the digits of the winner.

Conversations of any length. Rows are numbered by a range shuffle and cut into chunks. A chunk's
task finds the best path from every state to every state (16 integers); of equal
costs between the same two states none is the beginning of another, since edits of equal rows
differ in more than trailing insertions, so the least one stays least whatever follows. The chunks'
integers of a conversation are then put together from its end by the same minimum: about 12
bytes of weights per row, next to an audit of a letter per row that is asked for. The chosen
pieces go back to the chunks, which carry out their edits side by side.

Defined results: nulls are one space in every column that is compared or written; a null
conversation id is one conversation; rows are ordered by turn (nulls first), then role, then the
first 32 characters and the hash of the text, so repeated rows stand together; of repeated rows
the first may stay; empty texts are blank; a row whose role is empty cannot be kept as it is. A
conversation without rows gives zeros. Texts are never cut; only flags take part in the search.
No rows give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import numbered, sorted_groups
from gridload.session import discard, written

#: rows of a chunk
CHUNK = 1024
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = str.maketrans("1234", "DIKR")
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: states by what was last written: nothing, system, user, assistant
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: the state after a rerole or an insertion, and the role written
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: the state after a row that is kept
KEPT = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
#: at most this many rows need inserting in one place
INSERTIONS = 2
LEGAL = ("su", "ua", "au")
SOUND, BLANK, DUPLICATE, TRUNCATED = "", "blank", "duplicate", "truncated"


class Paths:
    """Weights with ``width`` octal letters below the cost."""

    def __init__(self, width: int) -> None:
        self.bits = 3 * width
        self.mask = (1 << self.bits) - 1

    def before(self, edit: int, cost: int, path: int | None) -> int | None:
        """The path with an edit put before it."""
        if path is None:
            return None
        letters = (path & self.mask) >> 3 | edit << (self.bits - 3)
        return ((path >> self.bits) + cost) << self.bits | letters

    def before_row(self, initial: str, fault: str, after: list) -> list:
        """Best path from each state when the row comes next; insertions precede it."""
        found = []
        for state in STATES:
            ways = [self.before(DELETE, COSTS[DELETE], after[state])]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED_COST if fault == TRUNCATED else 0
                ways.append(self.before(REROLE, COSTS[REROLE] + more, after[NEXT[state]]))
                kept = KEPT.get(initial, {}).get(state)
                if kept is not None:
                    ways.append(self.before(KEEP, COSTS[KEEP] + more, after[kept]))
            found.append(least(ways))
        return self.with_insertions(found)

    def with_insertions(self, after: list) -> list:
        found = after
        for _ in range(INSERTIONS):
            found = [
                least([after[s], self.before(INSERT, COSTS[INSERT], found[NEXT[s]])]) for s in STATES
            ]
        return found

    def letters(self, path: int) -> str:
        return format(path & self.mask, "o").zfill(self.bits // 3).rstrip("0").translate(LETTERS)


def least(ways: list) -> int | None:
    return min((w for w in ways if w is not None), default=None)


def width_of(rows: int) -> int:
    return rows * (1 + INSERTIONS) + 1


def chunk_paths(rows: list[tuple[str, str]]) -> list[dict]:
    """The best (cost, letters) between any two states over rows of (initial, fault)."""
    paths, found = Paths(width_of(len(rows))), []
    for last in STATES:
        after = [0 if s == last else None for s in STATES]
        for initial, fault in reversed(rows):
            after = paths.before_row(initial, fault, after)
        for first, path in enumerate(after):
            if path is not None:
                found.append({"first": first, "last": last, "cost": path >> paths.bits, "letters": paths.letters(path)})
    return found


_CODES = str.maketrans("DIKR", "1234")


def conversation_path(chunks: list[list[dict]]) -> tuple[int, list[tuple[int, str]]]:
    """(cost, per chunk its first state and letters) of the best path over all chunks."""
    width = INSERTIONS + 1
    ends = Paths(width)
    # at the end a system row alone needs two more rows, a user's one
    tails = ends.with_insertions([0, None, None, 0])
    bits, choices = ends.bits, []
    for chunk in reversed(chunks):
        longest = max(len(p["letters"]) for p in chunk)
        wider = bits + 3 * longest
        best: list = [None] * len(STATES)
        for p in chunk:
            tail = tails[p["last"]]
            if tail is None:
                continue
            size = 3 * len(p["letters"])
            letters = int(p["letters"].translate(_CODES), 8) << (wider - size)
            letters |= (tail & ((1 << bits) - 1)) << (wider - size - bits)
            path = ((tail >> bits) + p["cost"]) << wider | letters
            if best[p["first"]] is None or path < best[p["first"]][0]:
                best[p["first"]] = path, p
        choices.append([b and b[1] for b in best])
        tails, bits = [b and b[0] for b in best], wider
    state, pieces = START, []
    for chosen in reversed(choices):
        pieces.append((state, chosen[state]["letters"]))
        state = chosen[state]["last"]
    total = tails[START]
    whole = format(total & ((1 << bits) - 1), "o").zfill(bits // 3).rstrip("0").translate(LETTERS)
    # what the last chunk does not hold stands at the end: insertions after all rows
    done = sum(len(letters) for _, letters in pieces)
    pieces.append((state, whole[done:]))
    return total >> bits, pieces


def damage(turns: DataFrame, key: Column) -> DataFrame:
    """(conv_id, turn, role, text) with every row damaged by ``key``: 0 drops it, 1 empties its
    text, 2 takes out ``[.!?]``, 3 repeats it, 4 makes it a user's."""
    text = F.when(key == 1, "").when(key == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hit = turns.filter(F.coalesce(key != 0, F.lit(True))).select(
        "conv_id",
        "turn",
        F.when(key == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(key == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return hit.drop("_copy")


def spaced(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text): nulls of role and text are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), told(role).alias("role"), told(text).alias("text")
    )


def damage_key(turns: DataFrame) -> Column:
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.crc32(F.concat_ws(":", told("conv_id"), told("turn")).cast("binary")) % 20


def group_of(conv_id: str) -> Column:
    """A conversation's name, never null."""
    told = F.col(conv_id).cast("string")
    return F.when(told.isNull(), "-").otherwise(F.concat(F.lit(":"), told))


_BLANKS = r"\x20\x09-\x0D"


def with_faults(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with group, at, size, turn, role, text), (group, at, turn, initial, fault)."""
    rows = turns.select(
        group_of("conv_id").alias("group"), "turn", "role", "text",
        F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "turns")
    placed = numbered(rows, "group", ["turn", "role", "head", "hash", "row"], "at", "size")
    placed = written(placed.drop("head", "hash", "row"), "numbered")
    discard(rows)
    # the last character that is no blank, found from the end
    tail = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    narrow = placed.select(
        "group",
        "at",
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        (tail == "").alias("blank"),
        tail.rlike(r"[.!?]\z").alias("closed"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("same"),
    )
    first = (
        narrow.groupBy("group", "same")
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times"))
        .filter("times > 1")
        .drop("times")
    )
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("at") > F.col("first"), DUPLICATE)
        .when(~F.col("closed"), TRUNCATED)
        .otherwise(SOUND)
    )
    flagged = narrow.join(first, ["group", "same"], "left").select("group", "at", "turn", "initial", fault.alias("fault"))
    return placed, written(flagged, "faults")


_PATHS = "array<struct<first:int,last:int,cost:bigint,letters:string>>"


def plan(flagged: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(group, chunk, state, letters, cost, illegal): what each chunk does, from which state.
    ``cost`` and ``illegal`` are the conversation's; a last piece holds insertions at the end."""

    def search():
        def solved(groups) -> Iterator[tuple]:
            for (group, nth), rows in groups:
                rows = [(initial, fault) for _, _, _, initial, fault in rows]
                initials = [initial for initial, _ in rows]
                illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
                yield group, nth, chunk_paths(rows), illegal, initials[0], initials[-1]

        return solved

    def join():
        def joined(groups) -> Iterator[tuple]:
            for (group,), rows in groups:
                rows = list(rows)
                cost, pieces = conversation_path([r[2] for r in rows])
                illegal = sum(r[3] for r in rows)
                illegal += sum(a[5] + b[4] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
                for nth, (state, letters) in enumerate(pieces):
                    yield group, nth, state, letters, cost, illegal

        return joined

    cut = flagged.select("group", F.floor(F.col("at") / chunk).alias("chunk"), "at", "initial", "fault")
    solved = sorted_groups(
        cut, ["group", "chunk"], ["at"], search,
        f"group string, chunk bigint, paths {_PATHS}, illegal bigint, initial string, final string",
    )
    return sorted_groups(
        solved, ["group"], ["chunk"], join,
        "group string, chunk bigint, state int, letters string, cost bigint, illegal bigint",
    )


def apply_edits(placed: DataFrame, pieces: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(group, chunk, nth, edit, at, role, text): every edit in order. ``at`` is the source
    row's place (null if inserted); deleted rows have neither role nor text."""
    rows = placed.select(
        "group", F.floor(F.col("at") / chunk).alias("chunk"), "at", "role", "text", F.lit(None).cast("int").alias("state")
    )
    lead = pieces.select(
        "group", "chunk", F.lit(-1).cast("bigint").alias("at"), F.lit("").alias("role"), F.col("letters").alias("text"), "state"
    )

    def make():
        def edited(groups) -> Iterator[tuple]:
            for (group, nth_chunk), rows in groups:
                _, _, _, _, letters, state = next(rows)
                for nth, edit in enumerate(letters):
                    at = role = text = None
                    if edit == "I":
                        state = NEXT[state]
                        role, text = ROLE[state], ""
                    else:
                        _, _, at, role, text, _ = next(rows)
                        if edit == "K":
                            state = KEPT[role[:1]][state]
                        elif edit == "R":
                            state = NEXT[state]
                            role = ROLE[state]
                        else:
                            role = text = None
                    yield group, nth_chunk, nth, edit, at, role, text

        return edited

    return sorted_groups(
        rows.unionByName(lead), ["group", "chunk"], ["at"], make,
        "group string, chunk bigint, nth bigint, edit string, at bigint, role string, text string",
    )


def repair(
    turns: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """(edits, counts). ``edits``: see ``apply_edits``. ``counts``: (group, gaps, blank,
    duplicate, truncated, illegal, cost) per conversation with rows, see ``group_of``."""
    placed, flagged = with_faults(spaced(turns, conv_id, turn, role, text))
    pieces = written(plan(flagged, chunk), "pieces")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = flagged.groupBy("group").agg(
        F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in (BLANK, DUPLICATE, TRUNCATED)],
    )
    costs = pieces.filter("chunk = 0").select("group", "illegal", "cost")
    return apply_edits(placed, pieces, chunk), counts.join(costs, "group")


def told(edits: DataFrame) -> DataFrame:
    """(group, audit, repaired_sha256): the edits' letters and the digest of the repaired
    conversation's ``role:text`` lines. Rows stream through; only letters are kept."""

    def make():
        import hashlib

        def read(groups) -> Iterator[tuple]:
            for (group,), rows in groups:
                letters, state, lines = [], hashlib.sha256(), 0
                for _, _, _, edit, role, text in rows:
                    letters.append(edit)
                    if edit != "D":
                        state.update((("\n" if lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                        lines += 1
                yield group, "".join(letters), state.hexdigest()

        return read

    rows = edits.select("group", "chunk", "nth", "edit", "role", "text")
    return sorted_groups(rows, ["group"], ["chunk", "nth"], make, "group string, audit string, repaired_sha256 string")
