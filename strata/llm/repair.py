"""Conversation structure repair: the cheapest edits that make a conversation well formed.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles: perhaps a system row, then
user and assistant by turns, or nothing.  Edits: Keep a row (0), Rerole it to user or assistant (1),
Delete it (2; required for blank rows and repeats), Insert an empty user or assistant row (5);
a truncated row that is not deleted adds 5.  Of the cheapest lists of edits the one whose initials
are least in ASCII is taken.

Costs are found by Viterbi's algorithm from the end of a conversation, over four states (nothing
yet, after system, after user, after assistant), in parallel over chunks of ``CHUNK`` rows:

1. Every chunk but a conversation's last starts from a speculative cost vector.
2. Fix-up passes: a chunk whose end vector is not, up to a constant, the vector that the next
   chunk has at its beginning starts again from that.  It stops as soon as its new vectors differ
   from the former ones only by a constant, as then all earlier ones do (rank convergence).  Passes
   end when no chunk's vector changes; only differences matter, so vectors are kept less their
   least value.
3. The stitched costs drive the tracing: each chunk is traced from every state that it can be
   entered in, the entries are composed by pointer doubling, and each chunk's own edits are taken.

A conversation of any length is thus many short tasks, but for its digest, which is sequential by
nature: a task streams over the repaired rows in bounded memory.  The edits' initials of a whole
conversation are one value of the result.

Defined results: a null role or text is one space; a null ``conv_id`` is a conversation; null turns
come first, rows of one turn ordered by role, then text; a role is known by its first character,
and one without any cannot be kept; a conversation without rows has zero counts, no edits and the
empty string's digest; an empty table gives an empty result; very long texts are read whole; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import NOT_SPACE, placed, same, ship, written

ship(__name__)

CHUNK = 1024  # rows
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEXT = (2, 2, 3, 2)  # the state after one more user or assistant row; 0 nothing, 1 system, 2 user, 3 assistant
GOAL = (0, 2 * INSERT, INSERT, 0)  # cost to end well from each state
ROLES = ("s", "u", "a")  # a row's code is a letter: 3 * place of its role here (else 3) + 0 fine, 1 truncated, 2 to delete
LEGAL = {(0, 1), (1, 2), (2, 1)}  # neighbouring roles
FAULTS = ("dropped", "emptied", "unpunctuated", "repeated", "misattributed")


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the fault that crc32(``conv_id:turn``) mod 20 names, 0 to 4:
    dropped, emptied, unpunctuated, repeated, made a user's; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault"))
    times = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


# --- cost vectors ------------------------------------------------------------------------------------------
def options(code: str, state: int, after: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """Initial, cost and next state of the edits of one row from ``state``, by initial; ``after``
    has the costs behind the row.  Cost includes what follows."""
    role, kind = divmod(ord(code) - 65, 3)
    out = [("D", DELETE + after[state], state)]
    if kind < 2:
        more = TRUNCATED * kind
        to = {0: 1 if state == 0 else None, 1: 2 if state != 2 else None, 2: 3 if state == 2 else None}.get(role)
        if to is not None:
            out.append(("K", more + after[to], to))
        out.append(("R", REROLE + more + after[NEXT[state]], NEXT[state]))
    return out


def closed(costs: list[int]) -> tuple[int, ...]:
    """``costs`` if rows may be inserted first."""
    return tuple(min(costs[q], INSERT + costs[NEXT[q]], 2 * INSERT + costs[NEXT[NEXT[q]]]) for q in range(4))


def before(code: str, after: tuple[int, ...]) -> tuple[int, ...]:
    return closed([min(c for _, c, _ in options(code, q, after)) for q in range(4)])


def level(costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(c - min(costs) for c in costs)


class Steps(dict):
    """Levelled cost vectors by code and vector behind; there are few of them."""

    def __missing__(self, key):
        self[key] = out = level(before(*key))
        return out


def backward(codes: str, end: tuple[int, ...], steps: Steps, former: tuple[tuple[int, ...], tuple[int, ...]] | None = None) -> tuple[int, ...]:
    """The levelled vector before ``codes`` from ``end``; ``former`` has the end and beginning of an
    earlier run, which holds from where the two agree."""
    old = former[0] if former else None
    for code in reversed(codes):
        if end == old:
            return former[1]
        end = steps[code, end]
        old = steps[code, old] if former else None
    return end


def trace(codes: str, end: tuple[int, ...], last: bool, state: int) -> tuple[str, int, int]:
    """Initials, next state and cost of the least of the cheapest edits of ``codes`` from ``state``."""
    vectors = [end]
    for code in reversed(codes):
        vectors.append(before(code, vectors[-1]))
    vectors.reverse()
    out, cost = [], 0

    def step(initial: str, price: int, to: int) -> None:
        nonlocal cost, state
        out.append(initial)
        cost, state = cost + price, to

    for i, code in enumerate(codes):
        here, after = vectors[i], vectors[i + 1]
        while True:
            found = {o: (c, q) for o, c, q in options(code, state, after)}
            found["I"] = (INSERT + here[NEXT[state]], NEXT[state])
            initial = min(o for o, (c, _) in found.items() if c == here[state])
            c, to = found[initial]
            step(initial, c - (here[to] if initial == "I" else after[to]), to)
            if initial != "I":
                break
    while last and GOAL[state]:
        step("I", INSERT, NEXT[state])
    return "".join(out), state, cost


VECTORS = "conv_id {0}, chunk long, codes string, last boolean, end array<int>, begin array<int>"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beginnings of chunks from ``end``; ``former_end`` and ``begin`` are those of the pass before."""
    steps = Steps()
    for batch in batches:
        begins = []
        for r in batch.select(["codes", "end", "former_end", "begin"]).to_pylist():
            former = (tuple(r["former_end"]), tuple(r["begin"])) if r["begin"] else None
            begins.append(backward(r["codes"], tuple(r["end"]), steps, former))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "chunk", "codes", "last", "end")],
                                          pa.array(begins, pa.list_(pa.int32()))], ["conv_id", "chunk", "codes", "last", "end", "begin"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.select(["chunk", "codes", "last", "end"]).to_pylist():
            entries = range(4) if r["chunk"] else range(1)  # a conversation begins with nothing
            found = [trace(r["codes"], tuple(r["end"]), r["last"], q) for q in entries]
            out.append([{"edits": e, "state": q, "cost": c} for e, q, c in found])
        kind = pa.list_(pa.struct([("edits", pa.string()), ("state", pa.int32()), ("cost", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "chunk", "last")], pa.array(out, kind)],
                                         ["conv_id", "chunk", "last", "traces"])


def _beside(left: DataFrame, right: DataFrame, shift: int, columns: dict[str, str]) -> DataFrame:
    """``left`` with ``columns`` of the chunk ``shift`` places on."""
    right = right.select(F.col("conv_id").alias("_c"), (F.col("chunk") - shift).alias("_k"), *[F.col(a).alias(b) for a, b in columns.items()])
    return left.join(right.hint("merge"), same({"conv_id": "_c", "chunk": "_k"}), "left").drop("_c", "_k")


def converged(chunks: DataFrame) -> tuple[DataFrame, int]:
    """``chunks`` (``conv_id, chunk, codes, last``) with the right ``end`` vectors, and the passes
    that it took to fix them."""
    schema = VECTORS.format(chunks.schema["conv_id"].dataType.simpleString())
    goal = F.array(*[F.lit(c) for c in level(GOAL)])
    none = F.lit(None).cast("array<int>")
    state = chunks.select("conv_id", "chunk", "codes", "last", goal.alias("end"), none.alias("former_end"), none.alias("begin"))
    state, passes = written(state.mapInArrow(_vectors, schema), "vectors"), 0
    if state.where("NOT last").isEmpty():
        return state, passes
    while True:
        fixed = _beside(state, state, 1, {"begin": "needed"})
        wrong = "needed IS NOT NULL AND needed <> end"
        if fixed.where(wrong).isEmpty():
            return state, passes
        stay = fixed.where(f"NOT ({wrong}) OR needed IS NULL").drop("needed")
        again = fixed.where(wrong).select("conv_id", "chunk", "codes", "last", F.col("needed").alias("end"),
                                          F.col("end").alias("former_end"), "begin")
        state, passes = written(stay.unionByName(again.mapInArrow(_vectors, schema)), "vectors"), passes + 1


def least_edits(chunks: DataFrame) -> DataFrame:
    """``conv_id, chunk, edits, cost`` of every chunk."""
    state, _ = converged(chunks)
    kind = chunks.schema["conv_id"].dataType.simpleString()
    traced = written(state.mapInArrow(_traces, f"conv_id {kind}, chunk long, last boolean, "
                                               "traces array<struct<edits string, state int, cost long>>"), "traces")
    exits = traced.select("conv_id", "chunk", "last", F.col("traces.state").alias("to"))
    longest = exits.agg(F.max("chunk")).first()[0] or 0
    entered = F.lit(0)
    if longest:
        step, exits = 1, written(exits.where("chunk > 0 OR NOT last"), "exits")
        while step < longest:  # `to` leads from the entry of an ever earlier chunk, at last from the first one's
            far = _beside(exits, exits, -step, {"to": "first"})
            both = F.when(F.col("first").isNull(), F.col("to")).otherwise(F.transform("first", lambda q: F.get("to", q)))
            exits = written(far.select("conv_id", "chunk", "last", both.alias("to")), "exits")
            step *= 2
        traced = _beside(traced, exits, -1, {"to": "entry"})
        entered = F.coalesce(F.get("entry", F.lit(0)), F.lit(0))
    taken = F.get("traces", entered)
    return written(traced.select("conv_id", "chunk", taken["edits"].alias("edits"), taken["cost"].alias("cost")), "edits")


# --- conversations -----------------------------------------------------------------------------------------
def fault_rows(rows: DataFrame) -> DataFrame:
    """``placed`` rows -> ``conv_id, at, turn, role`` (its place among ``ROLES``, else 3) and ``fault``, the first of
    ``blank``, ``duplicate``, ``truncated`` that holds, or null."""
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.substring("role", 1, 1)).cast("int")
    slim = rows.select("conv_id", "at", "turn", F.when(role > 0, role - 1).otherwise(3).alias("role"), digest.alias("digest"),
                       (~F.col("text").rlike(NOT_SPACE)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    slim = written(slim, "conversation-rows")
    firsts = slim.groupBy("conv_id", "digest").agg(F.min("at").alias("_at")).select(F.col("conv_id").alias("_c"), "_at")
    marked = slim.join(firsts.hint("merge"), same({"conv_id": "_c", "at": "_at"}), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("_at").isNull(), "duplicate").when(F.col("cut"), "truncated")
    return written(marked.select("conv_id", "at", "turn", "role", fault.alias("fault")), "faults")


def chunked(rows: DataFrame) -> DataFrame:
    """``fault_rows`` -> ``conv_id, chunk, codes, last``, and ``illegal`` pairs of neighbours."""
    kind = F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), 2).otherwise(0)
    coded = rows.select("conv_id", F.floor(F.col("at") / CHUNK).alias("chunk"), "at", F.chr(65 + 3 * F.col("role") + kind).alias("code"))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda r: r["code"]), "")
    chunks = written(coded.groupBy("conv_id", "chunk").agg(codes.alias("codes")), "chunks")
    with_next = _beside(chunks, chunks, 1, {"codes": "next"})
    return written(with_next.select("conv_id", "chunk", "codes", F.col("next").isNull().alias("last"),
                                    F.concat("codes", F.coalesce(F.substring("next", 1, 1), F.lit(""))).alias("seen")), "chunk-codes")


def illegal_pairs(codes: Column) -> Column:
    """Neighbouring codes whose roles are not system-user, user-assistant or assistant-user."""
    role = lambda i: F.floor((F.ascii(F.substr(codes, i, F.lit(1))) - 65) / 3).cast("int")
    legal = lambda a, b: (((a == 0) | (a == 2)) & (b == 1)) | ((a == 1) & (b == 2))
    places = F.when(F.length(codes) > 1, F.sequence(F.lit(1), F.length(codes) - 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: ~legal(role(i), role(i + 1)))).cast("long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every conversation's repaired rows; rows come in order, the first of a chunk
    with the chunk's edits."""
    names, state, edits, digest, conv, begun = ("", "", "user", "assistant"), 0, iter(""), None, None, False
    kind = None

    def add(role: str, text: str) -> None:
        nonlocal begun
        digest.update((("\n" if begun else "") + f"{role}:{text}").encode())
        begun = True

    def insert(initials: Iterator[str]) -> str | None:
        """The next initial that is no insertion, or None at the end of the chunk."""
        nonlocal state
        for initial in initials:
            if initial != "I":
                return initial
            state = NEXT[state]
            add(names[state], "")
        return None

    def done() -> pa.RecordBatch:
        insert(edits)
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for r in batch.to_pylist():
            if digest is None or r["at"] == 0:
                if digest is not None:
                    yield done()
                state, digest, conv, begun = 0, sha256(), r["conv_id"], False
            if r["edits"] is not None:
                edits = iter(r["edits"])
            initial = insert(edits)
            if initial == "K":
                state = {"s": 1, "u": 2, "a": 3}[r["role"][0]]
                add(r["role"], r["text"])
            elif initial == "R":
                state = NEXT[state]
                add(names[state], r["text"])
    if digest is not None:
        yield done()


def repaired_digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: rows ``role:text``, joined by newlines."""
    first = edits.select(F.col("conv_id").alias("_c"), (F.col("chunk") * CHUNK).alias("_at"), "edits")
    with_edits = rows.select("conv_id", "at", "role", "text").join(first.hint("merge"), same({"conv_id": "_c", "at": "_at"}), "left")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return (with_edits.select("conv_id", "at", "role", "text", "edits").repartition("conv_id").sortWithinPartitions("conv_id", "at")
            .mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string"))


def repair(turns: DataFrame) -> DataFrame:
    """A row a conversation: ``conv_id, gaps`` (turns missing between its first and last), ``blank,
    duplicate, truncated`` (rows by first fault), ``illegal`` (neighbouring roles), ``cost``,
    ``audit`` (initials of its edits) and ``repaired_sha256``."""
    salted = written(turns.select("conv_id", "turn", "role", "text", F.rand(12).alias("salt")), "turns")
    rows = written(placed(salted, ["conv_id"], ["turn", "role", "text", "salt"]).drop("salt", "total"), "conversations")
    faults = fault_rows(rows)
    chunks = chunked(faults)
    edits = least_edits(chunks.select("conv_id", "chunk", "codes", "last"))
    counted = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    turn = F.col("turn").cast("long")
    by_turn = faults.groupBy("conv_id", "turn").agg(*counted).groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count(turn), F.lit(0)).alias("gaps"))
    pairs = chunks.groupBy("conv_id").agg(F.sum(illegal_pairs(F.col("seen"))).alias("illegal"))
    audits = edits.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk", "edits"))), lambda e: e["edits"]), "").alias("audit"))
    out = by_turn
    for other in (pairs, audits, repaired_digests(rows, edits)):
        out = out.join(other.withColumnRenamed("conv_id", "_c"), same({"conv_id": "_c"})).drop("_c")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_all(turns: DataFrame, of: DataFrame) -> DataFrame:
    """``repair`` with a row for every ``conv_id`` of ``of``, also those without a row in ``turns``."""
    found = repair(turns).withColumnRenamed("conv_id", "_c")
    every = of.select("conv_id").distinct()
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return (every.join(found, same({"conv_id": "_c"}), "left").drop("_c")
            .fillna({**zeros, "audit": "", "repaired_sha256": sha256(b"").hexdigest()}))
