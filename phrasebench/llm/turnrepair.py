"""Repair of conversation structure: the cheapest edits that make the roles fit ``(s?(ua)+)?``, by a run-length DP.

Every row becomes a symbol: the class of its role's initial (s, u, a or another) and its first fault: blank (no
character outside ASCII white space), duplicate (role and text seen earlier in the conversation), truncated (last such
character is none of ``.!?``). Edits and costs: Keep 0; Rerole to user or assistant 2; Delete 3, the only choice for
blank and duplicate rows; Insert an empty user or assistant row anywhere 2; a truncated row that stays adds 1.

The grammar has four states (start, after s, after u, after a), so a row is a 4 x 4 matrix over (min, +), insertions
before it included. Equal consecutive symbols are collapsed; the costs to go are carried backwards over a run of n
through the powers of two of its matrix, which are cached per worker. The audit is unrolled forwards: a block of 2^k
equal symbols is split into halves, each solved once per (symbol, k, state, relative costs to go) and cached. At a row
the ASCII-least letter on a cheapest path is taken (D < I < K < R); a letter leads to one state, so the audit fixes the
edits, and no cheapest audit is a prefix of another.

Spark: no text travels with the symbols. Equal rows of a turn are collapsed to a count, the first turn of each
(conversation, role, text digest) is a map-side combined minimum joined by a key that no two rows share, and rows are
sorted by range, so a conversation with a third of all rows is spread over many tasks; each range hands on its runs. A
conversation's runs meet in one task, because its audit, a letter a row, is one value of the result. The texts are
shuffled once; rows stream behind their audit into a running digest, in constant memory but for the audit.

Cases: a null conversation id is one conversation; rows are taken by turn, null turns first, then by role and text
digest; a null role or text is one space; a role that is empty or starts otherwise can't be kept as it is; equal rows
are duplicates from the second on; a conversation without rows has zeros, an empty audit and the digest of nothing; an
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasebench.llm.workers import cached
from phrasebench.session import cut_lineage

#: Costs of the edits, and what a truncated row adds when it stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A symbol is 4 * class + fault; classes s, u, a, other; faults none, blank, duplicate, truncated.
CLASSES, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The role that an inserted or changed row takes in a state.
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
INF = 1 << 60
#: Entries of the cache of unrolled blocks.
MAX_BLOCKS = 200_000

#: ASCII white space; a text without any other character is blank.
WHITE = " \t\n\x0b\x0c\r"


# ---- the DP --------------------------------------------------------------------------------------

def row_edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can happen to a row in a state, by letter."""
    kind, fault = divmod(symbol, 4)
    out = [("D", DELETE, state)]
    if fault not in (1, 2):
        more = TRUNCATED if fault == 3 else 0
        if kind + 1 == (AFTER_S if kind == 0 and state == START else NEXT[state]):
            out.append(("K", more, kind + 1))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


def _insert(costs: tuple) -> tuple:
    """Costs to go when any number of rows may be inserted first (two at most are of use)."""
    once = tuple(min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs))
    return tuple(min(c, INSERT + once[NEXT[s]]) for s, c in enumerate(once))


def _times(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(x + y for x, y in zip(row, col)) for col in zip(*b)) for row in a)


def _apply(matrix: tuple, costs: tuple) -> tuple:
    return tuple(min(x + y for x, y in zip(row, costs)) for row in matrix)


class Repair:
    """Solver of one worker: powers of the symbols' matrices and unrolled blocks, kept between conversations."""

    def __init__(self):
        self.powers: dict[tuple[int, int], tuple] = {}
        self.blocks: dict[tuple, tuple[str, int]] = {}

    def power(self, symbol: int, k: int) -> tuple:
        """Matrix of 2**k rows with this symbol: cost from a state to a state, insertions before each row included."""
        if (symbol, k) not in self.powers:
            if k:
                half = self.power(symbol, k - 1)
                made = _times(half, half)
            else:
                columns = []
                for end in range(4):
                    after = tuple(0 if s == end else INF for s in range(4))
                    columns.append(_insert(tuple(min(c + after[t] for _, c, t in row_edits(symbol, s)) for s in range(4))))
                made = tuple(zip(*columns))
            self.powers[symbol, k] = made
        return self.powers[symbol, k]

    def back(self, symbol: int, n: int, costs: tuple) -> tuple:
        """Costs to go before a run, from those after it."""
        k = 0
        while n:
            if n & 1:
                costs = _apply(self.power(symbol, k), costs)
            n, k = n >> 1, k + 1
        return costs

    def unroll(self, symbol: int, k: int, state: int, costs: tuple) -> tuple[str, int]:
        """(audit, last state) of 2**k rows from a state on, where ``costs`` are those to go behind them."""
        least = min(costs)
        costs = tuple(min(c - least, INF) for c in costs)
        key = symbol, k, state, costs
        if key not in self.blocks:
            if len(self.blocks) >= MAX_BLOCKS:
                self.blocks.clear()
            if k:
                first, middle = self.unroll(symbol, k - 1, state, _apply(self.power(symbol, k - 1), costs))
                second, end = self.unroll(symbol, k - 1, middle, costs)
                self.blocks[key] = first + second, end
            else:
                self.blocks[key] = self._row(symbol, state, costs)
        return self.blocks[key]

    @staticmethod
    def _row(symbol: int, state: int, costs: tuple) -> tuple[str, int]:
        after = [min(c + costs[t] for _, c, t in row_edits(symbol, s)) for s in range(4)]
        open_ = _insert(tuple(after))
        audit, spent = "", False
        while not spent:
            choices = [(letter, t, True) for letter, c, t in row_edits(symbol, state) if c + costs[t] == open_[state]]
            if INSERT + open_[NEXT[state]] == open_[state]:
                choices.append(("I", NEXT[state], False))
            letter, state, spent = min(choices)
            audit += letter
        return audit, state

    def solve(self, runs: list[tuple[int, int]]) -> tuple[int, str]:
        """(cost, audit) of a conversation given as (symbol, rows) runs."""
        costs = [_insert((0, INF, INF, 0))]
        for symbol, n in reversed(runs):
            costs.append(self.back(symbol, n, costs[-1]))
        total, state, audit = costs[-1][START], START, []
        for (symbol, n), after in zip(runs, reversed(costs[:-1])):
            # blocks of falling powers of two; the costs behind a block are those of the run's smaller rest
            for k in reversed(range(n.bit_length())):
                if n >> k & 1:
                    part, state = self.unroll(symbol, k, state, self.back(symbol, n & ((1 << k) - 1), after))
                    audit.append(part)
        open_ = _insert((0, INF, INF, 0))
        while open_[state]:  # what is inserted behind the last row
            audit.append("I")
            state = NEXT[state]
        return total, "".join(audit)


# ---- rows and symbols ----------------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): ``rows`` with faults of crc32("conv_id:turn") % 20; a null is one space.

    0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 makes it a user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    made = rows.withColumn("_kind", kind).where("_kind <> 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(space("role")).alias("role"), text.alias("text"),
        F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_copies"))
    return made.withColumn("_copy", F.explode("_copies")).select("conv_id", "turn", "role", "text")


def _kind(role: Column) -> Column:
    """Class of a role: 0 to 2 for s, u, a, else 3."""
    first = F.substring(role, 1, 1)
    out = F.lit(3)
    for i, letter in enumerate(CLASSES):
        out = F.when(first == letter, F.lit(i)).otherwise(out)
    return out


def _rows(rows: DataFrame) -> DataFrame:
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    last = F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"),
        F.when(last == "", F.lit(1)).when(last.isin(".", "!", "?"), F.lit(0)).otherwise(F.lit(3)).alias("fault"))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, symbol, n): rows of a conversation's turn that are alike, and their first symbol.

    Of n rows the first has ``symbol``; the others are duplicates (blank ones stay blank).
    """
    alike = rows.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count("*").alias("n"))
    alike = cut_lineage(alike)
    # a struct orders null turns first, as the rows are taken
    first = alike.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("t"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("t.turn").alias("u"))
    same = alike["conv_id"].eqNullSafe(first["c"]) & alike["turn"].eqNullSafe(first["u"]) & (
        alike["role"] == first["r"]) & (alike["digest"] == first["d"])
    fault = F.when(F.col("fault") == 1, F.lit(1)).when(F.col("r").isNull(), F.lit(2)).otherwise(F.col("fault"))
    return alike.join(first, same, "left").select(
        "conv_id", "turn", "role", "digest", (4 * _kind(F.col("role")) + fault).alias("symbol"), "n")


def _runs_of_range(batches):
    """(conv_id, part, runs): per conversation the runs of a range of sorted rows, as pairs of numbers in order."""
    from pyspark import TaskContext
    part, key, runs = TaskContext.get().partitionId(), (), []

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int64()), pa.array([part], pa.int32()), pa.array([[x for r in runs for x in r]], pa.list_(pa.int64()))],
            names=["conv_id", "part", "runs"])

    for batch in batches:
        for conv, symbol, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "symbol", "n"))):
            if key != (conv,):
                if key:
                    yield out()
                key, runs = (conv,), []
            again = 4 * (symbol // 4) + (1 if symbol % 4 == 1 else 2)
            for s, m in ((symbol, 1), (again, n - 1)):
                if m and runs and runs[-1][0] == s:
                    runs[-1][1] += m
                elif m:
                    runs.append([s, m])
    if key:
        yield out()


def join_runs(parts: list) -> list[tuple[int, int]]:
    """Runs of the parts in order, equal neighbours collapsed."""
    out: list[tuple[int, int]] = []
    for flat in parts:
        for s, n in zip(flat[::2], flat[1::2]):
            if out and out[-1][0] == s:
                out[-1] = s, out[-1][1] + n
            else:
                out.append((s, n))
    return out


def count_faults(runs: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and adjacent rows whose classes are not su, ua or au."""
    by = [sum(n for s, n in runs if s % 4 == f) for f in (1, 2, 3)]
    illegal = sum(n - 1 for _, n in runs) + sum((a // 4, b // 4) not in ((0, 1), (1, 2), (2, 1)) for (a, _), (b, _) in zip(runs, runs[1:]))
    return *by, illegal


_AUDIT = "conv_id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def audits(alike: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of every conversation with rows."""
    ordered = alike.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    parts = ordered.select("conv_id", "symbol", "n").mapInArrow(_runs_of_range, "conv_id bigint, part int, runs array<bigint>")
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "runs")))["runs"].alias("runs"))

    def run(batches):
        solver = cached("turnrepair", Repair)
        for batch in batches:
            made = []
            for parts_ in batch.column("runs").to_pylist():
                runs = join_runs(parts_)
                made.append((*count_faults(runs), *solver.solve(runs)))
            columns = [pa.array(list(c), pa.int64()) for c in list(zip(*made))[:5]] if made else [pa.array([], pa.int64())] * 5
            audit = pa.array([m[5] for m in made], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns, audit], names=[
                "conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return whole.mapInArrow(run, _AUDIT)


# ---- repaired texts ------------------------------------------------------------------------------

class _Digest:
    """Running digest of a conversation's repaired rows, given its audit first."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.first = audit, 0, START, hashlib.sha256(), True

    def _line(self, role: str, text: str) -> None:
        if not self.first:
            self.sha.update(b"\n")
        self.first = False
        self.sha.update(f"{role}:{text}".encode())

    def _role(self) -> str:
        self.state = NEXT[self.state]
        return "user" if self.state == AFTER_U else "assistant"

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._line(self._role(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self._line(self._role(), text)
        elif letter == "K":
            self.state = AFTER_S if role[:1] == "s" else NEXT[self.state]
            self._line(role, text)

    def hex(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def _digests(batches):
    key, held = (), None
    ids, made = [], []
    for batch in batches:
        for conv, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit is not None:
                if held:
                    ids.append(key[0])
                    made.append(held.hex())
                key, held = (conv,), _Digest(audit)
            else:
                held.row(role, text)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.string())], names=["conv_id", "repaired_sha256"])
        ids, made = [], []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([held.hex()], pa.string())], names=["conv_id", "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repaired rows, per conversation of ``rows`` (conv_id, turn, role, text)."""
    rows = _rows(rows)
    made = cut_lineage(audits(symbols(rows)))
    none = F.lit(None)
    lines = made.select("conv_id", "audit", none.cast("bigint").alias("turn"), none.cast("string").alias("role"),
                        none.cast("binary").alias("digest"), none.cast("string").alias("text"), F.lit(0).alias("kind"))
    lines = lines.unionByName(rows.select("conv_id", none.cast("string").alias("audit"), "turn", "role", "digest", "text", F.lit(1).alias("kind")))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    digests = lines.select("conv_id", "audit", "role", "text").mapInArrow(_digests, "conv_id bigint, repaired_sha256 string")
    turns = rows.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    distinct = rows.where("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count("*").alias("m"))
    gaps = _side(turns.join(_side(distinct, "d"), F.col("conv_id").eqNullSafe(F.col("d_conv_id")), "left").select(
        "conv_id", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("d_m"), F.lit(0)).cast("bigint").alias("gaps")), "g")
    digests = _side(digests, "h")
    return made.join(gaps, made["conv_id"].eqNullSafe(gaps["g_conv_id"])).join(
        digests, made["conv_id"].eqNullSafe(digests["h_conv_id"])).select(
        "conv_id", F.col("g_gaps").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("h_repaired_sha256").alias("repaired_sha256"))


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def repair_all(original: DataFrame, rows: DataFrame) -> DataFrame:
    """``repair`` of ``rows`` for every conversation of ``original``, those that kept no row included."""
    ids = original.select(F.col("conv_id").alias("o")).distinct()
    made = repair(rows)
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return ids.join(made, ids["o"].eqNullSafe(made["conv_id"]), "left").select(
        F.col("o").alias("conv_id"), *[c.alias(n) for n, c in zero.items()], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
