"""State machines folded over ordered logs, as prefix scans.

A row of a log is a step: for each state the one that follows. Steps compose, and composition is associative, so a log is cut into blocks,
each block becomes one step, blocks are cut into larger blocks, and only the few steps on top are folded one after another; then
states are handed down. A key with a third of all rows is cut like any other: blocks come from a table sorted by ranges, not from a window over the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.sources.scratch import saved, shared_folder

#: Rows of a sorted part, of which a key may fill any number; and steps in a block.
PART_ROWS, BLOCK_STEPS = 1 << 18, 512


@dataclass(frozen=True)
class Machine:
    """States by name, the first one being where each key begins, and what commands do: moves[command][state] = (next state, code).

    States that a command does not list stay as they are and get its `else` code; unknown commands get code 400.
    """

    states: tuple[str, ...]
    moves: dict[str, dict[str, tuple[str, int]]]
    otherwise: dict[str, int]

    def _table(self) -> dict[str, list[tuple[int, int]]]:
        at = self.states.index
        return {c: [(at(m[s][0]), m[s][1]) if s in m else (at(s), self.otherwise[c]) for s in self.states] for c, m in self.moves.items()}

    def _literal(self, command: Column, which: int, unknown: list[int]) -> Column:
        pairs = [x for c, row in self._table().items() for x in (F.lit(c), F.array(*[F.lit(cell[which]) for cell in row]))]
        return F.coalesce(F.element_at(F.create_map(*pairs), command), F.array(*map(F.lit, unknown)))

    def step(self, command: Column) -> Column:
        """Next state for each state, by number."""
        return self._literal(command, 0, list(range(len(self.states))))

    def codes(self, command: Column) -> Column:
        return self._literal(command, 1, [400] * len(self.states))

    def name(self, state: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.states)), state + 1)

    def run(self, commands: list[str | None]) -> list[tuple[str, str, int]]:
        """(state before, state after, code) of each command, one after another."""
        out, state, table = [], 0, self._table()
        for c in commands:
            after, code = table[c][state] if c in table else (state, 400)
            out.append((self.states[state], self.states[after], code))
            state = after
        return out


def _identity(states: int) -> Column:
    return F.array(*[F.lit(s) for s in range(states)])


def _composed(steps: Column, states: int) -> Column:
    """One step from an array of structs with `step`, in order."""
    return F.aggregate(steps, _identity(states), lambda done, r: F.transform(done, lambda s: F.get(r["step"], s)))


def _states_before(steps: Column, first: Column) -> Column:
    """The state before each step of an array of structs with `step`."""
    start = F.struct(first.cast("int").alias("now"), F.array().cast("array<int>").alias("seen"))
    walk = F.aggregate(steps, start, lambda a, r: F.struct(F.get(r["step"], a["now"]).alias("now"), F.concat(a["seen"], F.array(a["now"])).alias("seen")))
    return walk["seen"]


def _gathered(rows: DataFrame, by: list[str], order: list[str], carried: list[str]) -> DataFrame:
    """One row for each group, with its steps in order."""
    entry = F.struct(*order, "step", *carried)
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("steps"))


def _spread(groups: DataFrame, keep: list[str], first: Column) -> DataFrame:
    """Rows of the groups again, with the state before each."""
    zipped = groups.select(*keep, "steps", _states_before(F.col("steps"), first).alias("seen"))
    return zipped.select(*keep, F.inline(F.arrays_zip("steps", "seen"))).select(*keep, "steps.*", F.col("seen").alias("state_before"))


def _starts(blocks: DataFrame, key: list[str], order: list[str], states: int, size: int, levels: int) -> DataFrame:
    """The state before each block: key, order, state_before."""
    if not levels:
        return _spread(_gathered(blocks, key, order, []), key, F.lit(0)).select(*key, *order, "state_before")
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1
    larger = _gathered(blocks.withColumn(f"__g{levels}", F.floor(place / size)), [*key, f"__g{levels}"], order, [])
    above = _starts(larger.select(*key, f"__g{levels}", _composed(F.col("steps"), states).alias("step")), key, [f"__g{levels}"], states, size, levels - 1)
    joined = larger.join(above.withColumnRenamed("state_before", "__first"), [*key, f"__g{levels}"])
    return _spread(joined, key, F.col("__first")).select(*key, *order, "state_before")


def scan_states(log: DataFrame, key: list[str], order: list[str], step: Column, states: int, part_rows: int = PART_ROWS, block: int = BLOCK_STEPS) -> DataFrame:
    """Adds state_before and state_after (numbers) to each row of the log; every key begins in state 0.

    Rows of a key are taken by `order`, which must tell them apart; rows that agree in all of it are taken in the order of their other
    columns. Null keys are a key like others, a null in `order` comes first. An empty log gives no rows.
    """
    folder = shared_folder(log.sparkSession)
    kept = [c for c in log.columns if c not in {"state_before", "state_after"}]
    rest = [c for c in kept if c not in {*key, *order}]
    # Keys and order are renamed, so that no column of the log clashes with those of the scan.
    keys, orders = [f"__k{i}" for i in range(len(key))], [f"__o{i}" for i in range(len(order))]
    renamed = log.select(*[F.struct(F.col(f"`{k}`")).alias(n) for k, n in zip(key, keys)], *[F.struct(F.col(f"`{o}`")).alias(n) for o, n in zip(order, orders)], step.alias("step"), F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in rest]).alias("row"))
    parts = -(-log.count() // part_rows) or 1
    # The ranges are drawn once and written: both passes below must see the same parts.
    sorted_log = saved(renamed.repartitionByRange(parts, *keys, *orders).withColumn("__part", F.spark_partition_id()), folder, "log")
    place = F.row_number().over(W.partitionBy("__part", *keys).orderBy(*orders, "row")) - 1
    blocks = saved(_gathered(sorted_log.withColumn("__block", F.floor(place / block)), [*keys, "__part", "__block"], orders, ["row"]), folder, "blocks")
    # Keys are structs, which are never null, so null keys join like others.
    firsts = _starts(blocks.select(*keys, "__part", "__block", _composed(F.col("steps"), states).alias("step")), keys, ["__part", "__block"], states, block, 1)
    joined = blocks.join(firsts.withColumnRenamed("state_before", "__first"), [*keys, "__part", "__block"])
    rows = _spread(joined, keys, F.col("__first"))
    columns = {k: F.col(n)[k] for k, n in zip(key, keys)} | {o: F.col(n)[o] for o, n in zip(order, orders)} | {c: F.col("row")[c] for c in rest}
    return rows.select(*[columns[c].alias(c) for c in kept], "state_before", F.get("step", F.col("state_before")).alias("state_after"))


#: A chapter's translation: at most one job is active (running or paused) at any time.
CHAPTER_JOB = Machine(
    ("none", "running", "paused", "completed", "partial", "failed"),
    {
        "start": {"none": ("running", 200), "completed": ("completed", 400), "partial": ("partial", 400), "failed": ("failed", 400)},
        "open": {"none": ("running", 200)},
        "pause": {"running": ("paused", 200), "paused": ("paused", 204)},
        "resume": {"paused": ("running", 200), "running": ("running", 204)},
        "retry": {"partial": ("running", 200), "failed": ("running", 200), "completed": ("completed", 204), "none": ("none", 404)},
        "finish_completed": {"running": ("completed", 200)},
        "finish_partial": {"running": ("partial", 200)},
        "finish_failed": {"running": ("failed", 200)},
    },
    {"start": 409, "open": 204, "pause": 404, "resume": 404, "retry": 409, "finish_completed": 409, "finish_partial": 409, "finish_failed": 409},
)

#: A book's parsing: a second parse while one goes on is refused, a crash leaves it failed, and so it may be parsed again.
BOOK_PARSE = Machine(
    ("pending", "parsing", "assembling", "completed", "failed", "deleted"),
    {
        "parse": {"pending": ("parsing", 200), "completed": ("parsing", 200), "failed": ("parsing", 200), "deleted": ("deleted", 404)},
        "pages_done": {"parsing": ("assembling", 200)},
        "assembled": {"assembling": ("completed", 200)},
        "crash": {"parsing": ("failed", 200), "assembling": ("failed", 200)},
        "delete": {s: ("deleted", 200) for s in ("pending", "parsing", "assembling", "completed", "failed")},
    },
    {"parse": 409, "pages_done": 409, "assembled": 409, "crash": 204, "delete": 404},
)


def judged(log: DataFrame, machine: Machine, key: list[str], order: list[str], command: str = "command", **scan) -> DataFrame:
    """What became of each command: state_before and state_after by name, code (200 done, 204 nothing to do, 4xx refused), accepted.

    Refused commands stay as rows. A null or unknown command is refused with 400.
    """
    states = scan_states(log, key, order, machine.step(F.col(command)), len(machine.states), **scan)
    coded = states.withColumn("code", F.get(machine.codes(F.col(command)), F.col("state_before")))
    return coded.withColumns({"state_before": machine.name(F.col("state_before")), "state_after": machine.name(F.col("state_after")), "accepted": F.col("code") == 200})
