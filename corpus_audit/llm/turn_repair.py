"""Repair of conversations whose turns are blank, repeated, cut off or out of order, at the least cost.

Turns are aligned to the strings of ``(s?(ua)+)?``, in initials of system, user and assistant: for every feasible
length the Wagner-Fischer table of turns against that string.  Anchored at their ends, the strings of all
lengths are one string, so one table holds them all, row by row, and each row only the band of cells that can stay
within the cost of the best script known so far (Ukkonen).  The cheapest lengths are traced back, and the least of
their audits wins.

An audit spells the edits in order: K keep, R give another role (1), D delete (2), I insert an empty turn (5); a cut-off
turn that is not deleted costs 5 more.

Long conversations are cut into pieces of ``PIECE`` turns.  A piece is aligned from each state it can be
entered in to each one it can be left in.  Inserted turns belong to the turn behind them, so no audit of a piece is the
beginning of another, and the least audit of a conversation is made of least audits of pieces.  A second pass
over the pieces' costs, without texts or turns, picks one of each.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_audit.llm.common import stored

REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
PIECE = 256
BLANKS = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # nothing yet; after a system turn; a user turn is next; an assistant turn is next
STATES = (START, SYSTEM, USER, ASSISTANT)
_INF = 1 << 40
_COUNT = np.arange(4 * PIECE, dtype=np.int64)
# Another state costs at most two inserted turns: scripts that are this much dearer than another one are never used.
_DETOUR = 2 * INSERT

# A turn's code: s, u, a or x for its role's initial (x: any other), upper case when it is cut off, - when it must go
_LEAST = {"-": DELETE, "S": DELETE, "U": DELETE, "A": DELETE, "X": DELETE, "x": REROLE, "s": 0, "u": 0, "a": 0}


def _kept(code: str, wanted: str) -> int:
    """The cost of a turn in the place of a wanted initial."""
    if code == "-" or (wanted == "s" and code not in "sS"):
        return _INF
    return (CUT if code.isupper() else 0) + (0 if code.lower() == wanted else REROLE)


def _fits(state: int, initial: str) -> bool:
    return (initial == "s" and state == START) or (initial == "u" and state != ASSISTANT) or (initial == "a" and state == ASSISTANT)


def _after(initial: str) -> int:
    return {"s": SYSTEM, "u": ASSISTANT, "a": USER}[initial]


def _ending(state: int) -> int:
    """Turns to insert where a conversation ends."""
    return {SYSTEM: 2, ASSISTANT: 1}.get(state, 0)


def _plain_cost(codes: str, state: int, final: bool) -> int:
    """The cheapest of a few plain scripts: delete everything, or keep what fits and treat the rest in one way."""
    best = DELETE * len(codes) + (INSERT * _ending(state) if final else 0)
    for delete_cut in (True, False):
        for delete_others in (True, False):
            cost, at = 0, state
            for code in codes:
                initial, cut = code.lower(), code.isupper()
                if code == "-" or (cut and delete_cut):
                    cost += DELETE
                elif _fits(at, initial):
                    cost, at = cost + CUT * cut, _after(initial)
                elif delete_others:
                    cost += DELETE
                else:
                    cost, at = cost + REROLE + CUT * cut, USER if at == ASSISTANT else ASSISTANT
            best = min(best, cost + (INSERT * _ending(at) if final else 0))
    return best


class Table:
    """Costs of aligning turns ``i`` to the end with the last ``q`` initials of a string that ends before ``exit``."""

    def __init__(self, codes: str, exit: int, final: bool, bound: int, least: list[int]):
        self.codes, self.final = codes, final
        self.odd, self.even = ("a", "u") if exit == USER else ("u", "a")  # the initial q places before the end
        n = len(codes)
        ends = INSERT * _COUNT[: max(0, bound - least[n]) // INSERT + 1] if final else _COUNT[:1]
        self.rows: list[tuple[int, np.ndarray]] = [(0, ends)] * (n + 1)
        for i in range(n - 1, -1, -1):
            self.rows[i] = self._row(i, bound - least[i])

    def _row(self, i: int, bound: int) -> tuple[int, np.ndarray]:
        low, below = self.rows[i + 1]
        size = len(below)
        if not size:
            return low, below
        more = max(0, bound - int(below.min())) // INSERT
        row = np.full(size + 1 + more, _INF)
        row[:size] = below + DELETE
        kept = np.where((_COUNT[:size] + low + 1) & 1, _kept(self.codes[i], self.odd), _kept(self.codes[i], self.even))
        np.minimum(row[1 : size + 1], below + kept, out=row[1 : size + 1])
        steps = INSERT * _COUNT[: len(row)]
        row = np.minimum.accumulate(row - steps) + steps
        band = np.flatnonzero(row <= bound)
        return (low + int(band[0]), row[band[0] : band[-1] + 1]) if len(band) else (low, row[:0])

    def cost(self, i: int, q: int) -> int:
        low, row = self.rows[i]
        return int(row[q - low]) if 0 <= q - low < len(row) else _INF

    def initial(self, q: int) -> str:
        return self.odd if q & 1 else self.even

    def lengths(self, i: int = 0):
        low, row = self.rows[i]
        return ((low + k, int(c)) for k, c in enumerate(row) if c < _INF)

    def trace(self, i: int, q: int) -> str:
        """The least audit of that cost: at each cell the least letter on a cheapest way."""
        out, n = [], len(self.codes)
        while i < n or q:
            cost = self.cost(i, q)
            if i < n and self.cost(i + 1, q) + DELETE == cost:
                out.append("D")
                i += 1
            elif q and (i < n or self.final) and self.cost(i, q - 1) + INSERT == cost:
                out.append("I")
                q -= 1
            else:
                out.append("K" if self.codes[i].lower() == self.initial(q) else "R")
                i, q = i + 1, q - 1
        return "".join(out)


def _with_system(table: Table) -> dict[int, tuple[int, list[int]]]:
    """By length behind a kept system turn: the least cost, and which turns can be that one."""
    found: dict[int, tuple[int, list[int]]] = {}
    for i, code in enumerate(table.codes):
        if code in "sS":
            for q, c in table.lengths(i + 1):
                if q and table.initial(q) == "u":
                    cost = c + DELETE * i + _kept(code, "s")
                    have = found.get(q)
                    if have is None or cost < have[0]:
                        found[q] = (cost, [i])
                    elif cost == have[0]:
                        have[1].append(i)
    return found


@lru_cache(maxsize=20_000)
def align(codes: str, first: bool = True, final: bool = True) -> tuple[tuple[int, int, int, str], ...]:
    """``entry, exit, cost, audit`` of the cheapest scripts of a run of turns, ties by the least audit.

    ``first``: nothing goes before, so the entry is ``START``; ``final``: nothing follows, so the whole must be a string of the
    grammar, and the exit is ``USER`` or, if nothing remains, ``START``.  Else all states that can matter.
    """
    entries = (START,) if first else STATES
    least = [0]
    for code in codes:
        least.append(least[-1] + _LEAST[code])
    bound = max(_plain_cost(codes, e, final) for e in entries) + (0 if final else _DETOUR)
    n, out = len(codes), []

    def best(entry, exit, options):
        """options: cost and a function that traces the audit."""
        if options and (cheapest := min(c for c, _ in options)) <= bound:
            out.append((entry, exit, cheapest, min(trace() for c, trace in options if c == cheapest)))

    gone = (DELETE * n, lambda: "D" * n)
    for exit in (USER,) if final else (USER, ASSISTANT):
        table = Table(codes, exit, final, bound, least)
        system = _with_system(table) if any(c in "sS" for c in codes) else {}
        for entry in entries:
            wanted = "a" if entry == ASSISTANT else "u"
            options = [(c, lambda q=q: table.trace(0, q)) for q, c in table.lengths() if (table.initial(q) == wanted if q else entry == exit)]
            if entry == START:
                options += [(c, lambda i=i, q=q: "D" * i + "K" + table.trace(i + 1, q)) for q, (c, at) in system.items() for i in at]
                if final:
                    options.append(gone)
            best(entry, exit, options)
    if not final:
        for entry in entries:
            if entry == START:
                best(START, START, [gone])
                best(START, SYSTEM, [(DELETE * (n - 1) + _kept(c, "s"), lambda i=i: "D" * i + "K" + "D" * (n - 1 - i)) for i, c in enumerate(codes) if c in "sS"])
            elif entry == SYSTEM:
                best(SYSTEM, SYSTEM, [gone])
    return tuple(out)


def script(codes: str, audit: str, entry: int = START) -> list[tuple[int | None, str | None]]:
    """The turns that an audit leaves: the number of the turn (none if inserted) and its new role (none if kept)."""
    out, i, state = [], 0, entry
    for letter in audit:
        if letter == "K":
            out.append((i, None))
            state = _after(codes[i].lower())
        elif letter != "D":
            out.append((None if letter == "I" else i, "assistant" if state == ASSISTANT else "user"))
            state = USER if state == ASSISTANT else ASSISTANT
        i += letter != "I"
    return out


# Turns to pieces


def _facts(rows: DataFrame) -> DataFrame:
    """Rows without texts: ``uid, conv_id, turn, role, d`` (digest of the text), ``initial`` and ``fault``."""
    trimmed = F.btrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(trimmed == "", "blank").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "cut").otherwise("")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return rows.select("uid", "conv_id", "turn", "role", F.unhex(F.md5("text")).alias("d"), initial.alias("initial"), fault.alias("fault"))


def _marked(rows: DataFrame) -> DataFrame:
    """``_facts`` of different rows with their number ``n`` and ``again``: an earlier turn of the conversation has that role and text."""
    keys = ["conv_id", "turn", "role", "d", "initial", "fault"]
    facts = stored(_facts(rows).groupBy(*keys).agg(F.min("uid").alias("uid"), F.count("*").alias("n")), "facts")
    order = F.struct(F.col("turn").isNotNull(), "turn")
    first = facts.groupBy("conv_id", "role", "d").agg(F.min(order).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    first = stored(first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("d").alias("e"), "first"), "firsts")
    same = facts["conv_id"].eqNullSafe(first["c"]) & (F.col("role") == F.col("r")) & (F.col("d") == F.col("e"))
    return facts.join(first, same, "left").select(*facts.columns, F.coalesce(F.col("first") < order, F.lit(False)).alias("again"))


_OPTIONS = "array<struct<entry:int,exit:int,cost:long,audit:string>>"
_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long"
_PIECES = f"conv_id long, piece long, open boolean, codes string, uids array<long>, {_COUNTS}, first string, last string, first_turn long, last_turn long, min_turn long, max_turn long, options {_OPTIONS}"
_LEGAL = {"su", "ua", "au"}


class _Piece:
    """Turns of one conversation that follow each other, while they are read."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.uids = conv_id, [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.first_turn = self.last_turn = self.min_turn = None

    def add(self, turn, initial: str, fault: str, duplicate: bool, uid: int) -> None:
        if self.last is None:
            self.first, self.first_turn = initial, turn
        else:
            self.illegal += self.last + initial not in _LEGAL
        if turn is not None and (self.min_turn is None or turn != self.last_turn):
            self.turns += 1
            self.min_turn = turn if self.min_turn is None else self.min_turn
        self.last, self.last_turn = initial, turn
        self.blank += fault == "blank"
        gone = fault == "blank" or duplicate
        self.duplicate += duplicate and fault != "blank"
        self.truncated += fault == "cut" and not gone
        self.codes.append("-" if gone else initial.upper() if fault == "cut" else initial)
        self.uids.append(uid)

    def row(self, piece: int, opened: bool, follows: bool) -> tuple:
        """``opened``: turns may go before; ``follows``: turns may follow."""
        codes = "".join(self.codes)
        options = [dict(zip(("entry", "exit", "cost", "audit"), o)) for o in align(codes, not opened, not follows)]
        return (
            self.conv_id, piece, opened or follows, codes, self.uids, self.blank, self.duplicate, self.truncated, self.illegal, self.turns,
            self.first, self.last, self.first_turn, self.last_turn, self.min_turn, self.last_turn, options,
        )


def _arrow_rows(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _arrow_schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _pieces(marked: DataFrame, size: int) -> DataFrame:
    """Conversations in pieces.  Rows are sorted over ranges of conversation and turn, so a long conversation spreads over
    tasks; a piece that may go on in a neighbouring range or piece is ``open`` and has the scripts of all states."""
    ranged = marked.repartitionByRange("conv_id", "turn", "role", "d").sortWithinPartitions("conv_id", "turn", "role", "d")
    ranged = ranged.select("conv_id", "turn", "initial", "fault", "again", "n", "uid", F.spark_partition_id().cast("long").alias("part"))
    schema = _arrow_schema(_PIECES)

    def cut(batches):
        out, held, opened, number, part = [], None, True, 0, 0

        def done(follows):
            nonlocal number
            out.append(held.row(part << 40 | number, opened, follows))
            number += 1

        for batch in batches:
            part = batch["part"][0].as_py() if len(batch) else part
            for conv_id, turn, initial, fault, again, n, uid in zip(*[batch[c].to_pylist() for c in ("conv_id", "turn", "initial", "fault", "again", "n", "uid")]):
                if held is not None and conv_id != held.conv_id:
                    done(False)
                    held, opened = None, False
                for k in range(n):
                    if held is not None and len(held.codes) == size:
                        done(True)
                        held, opened = None, True
                    held = held or _Piece(conv_id)
                    held.add(turn, initial, fault, again or k > 0, uid)
                    if len(out) == 500:
                        yield _arrow_rows(out, schema)
                        out.clear()
        if held is not None:
            done(True)
        if out:
            yield _arrow_rows(out, schema)

    return ranged.mapInArrow(cut, _PIECES)


def _choices(pieces: DataFrame) -> DataFrame:
    """``piece, chosen`` (number of the option), ``tail`` (inserted turns at the end), ``extra_illegal`` and ``shared_turn`` (between
    it and the piece before) of open pieces.  Only costs and the rank of audits are read here, a few numbers a piece."""
    ranks = F.transform("options", lambda o: F.struct(o["entry"], o["exit"], o["cost"], F.size(F.filter("options", lambda p: p["audit"] < o["audit"])).alias("rank")))
    narrow = pieces.where("open").select("conv_id", "piece", "first", "last", "first_turn", "last_turn", ranks.alias("options"))
    ordered = narrow.repartition("conv_id").sortWithinPartitions(F.asc("conv_id"), F.desc("piece"))
    columns = narrow.columns
    ddl = "piece long, chosen int, tail string, extra_illegal long, shared_turn long"
    schema = _arrow_schema(ddl)

    def chosen(held):
        """``held``: number, best option by entry, and ends of a conversation's pieces, last one first."""
        state, out, before = START, [], None
        for piece, best, first, last, first_turn, last_turn, is_last in reversed(held):
            k, exit = best[state]
            illegal = before is not None and before[0] + first not in _LEGAL
            shared = before is not None and first_turn is not None and before[1] == first_turn
            out.append((piece, k, "I" * _ending(exit) if is_last else "", int(illegal), int(shared)))
            state, before = exit, (last, last_turn)
        return _arrow_rows(out, schema)

    def choose(batches):
        held, conv, cost = [], None, None
        for batch in batches:
            for conv_id, piece, first, last, first_turn, last_turn, options in zip(*[batch[c].to_pylist() for c in columns]):
                if held and conv_id != conv:
                    yield chosen(held)
                    held = []
                is_last, conv = not held, conv_id
                cost = {s: INSERT * _ending(s) for s in STATES} if is_last else cost
                best = {}
                for k, o in enumerate(options):
                    if o["exit"] in cost:
                        found = (o["cost"] + cost[o["exit"]], o["rank"], k, o["exit"])
                        best[o["entry"]] = min(best.get(o["entry"], found), found)
                cost = {entry: found[0] for entry, found in best.items()}
                held.append((piece, {entry: found[2:] for entry, found in best.items()}, first, last, first_turn, last_turn, is_last))
        if held:
            yield chosen(held)

    return ordered.mapInArrow(choose, ddl)


def repair(rows: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Rows ``conv_id, turn, role, text`` to audits and repaired turns.

    Audits: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, a row for each conversation.  Turns: ``conv_id,
    piece, place`` (their order), ``turn`` (null if inserted), ``role, text``.  Texts of ``rows`` are stored once and
    meet their place by row number.

    A turn's first fault counts: blank, duplicate of an earlier turn's role and text, cut off (its last character but blanks
    is none of ``.!?``).  Turns are taken by ``turn``, nulls first, those of one ``turn`` by role and a digest of their text;
    whole copies follow each other.  ``illegal`` counts neighbours whose initials are not su, ua or au; ``gaps`` the missing
    numbers between the least and the largest turn.  Null roles and texts count as one blank; an empty role
    has no initial and can only be changed or deleted.  Rows without ``conv_id`` are one conversation.  Other columns are
    ignored; an empty table gives empty results.
    """
    known = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    known = stored(known.withColumn("uid", F.monotonically_increasing_id()), "turns")
    pieces = stored(_pieces(_marked(known), piece), "pieces")
    choices = stored(_choices(pieces), "choices").withColumnRenamed("piece", "p")
    counts = ["conv_id", "piece", "codes", "uids", "blank", "duplicate", "truncated", "illegal", "turns", "min_turn", "max_turn"]
    closed = pieces.where("NOT open").select(*counts, F.col("options")[0].alias("o"), F.lit("").alias("tail"), F.lit(0).alias("extra"), F.lit(0).alias("shared"))
    opened = pieces.where("open").join(choices, F.col("piece") == F.col("p"))
    opened = opened.select(*counts, F.get("options", F.col("chosen")).alias("o"), "tail", F.col("extra_illegal").alias("extra"), F.col("shared_turn").alias("shared"))
    done = closed.unionByName(opened).withColumn("audit", F.concat("o.audit", "tail"))

    by_conv = done.groupBy("conv_id").agg(
        (F.try_subtract(F.max("max_turn"), F.min("min_turn")) + 1 - F.sum(F.col("turns") - F.col("shared"))).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + F.col("extra")).alias("illegal"),
        F.sum(F.col("o.cost") + INSERT * F.length("tail")).alias("cost"),
        # The audit itself is a letter a turn or more, so its parts are no larger than the result.
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda a: a["audit"]), "").alias("audit"),
    )
    return by_conv.withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long")), _turns(done, known)


def _turns(done: DataFrame, known: DataFrame) -> DataFrame:
    ddl = "conv_id long, piece long, place int, uid long, new_role string"
    schema = _arrow_schema(ddl)

    def spell(batches):
        for batch in batches:
            out = []
            for conv_id, piece, codes, uids, entry, audit in zip(*[batch[c].to_pylist() for c in ("conv_id", "piece", "codes", "uids", "entry", "audit")]):
                out += [(conv_id, piece, place, None if i is None else uids[i], role) for place, (i, role) in enumerate(script(codes, audit, entry))]
            for k in range(0, len(out), 10_000):
                yield _arrow_rows(out[k : k + 10_000], schema)

    placed = stored(done.select("conv_id", "piece", "codes", "uids", F.col("o.entry").alias("entry"), "audit").mapInArrow(spell, ddl), "placed")
    texts = known.select(F.col("uid").alias("u"), "turn", "role", "text")
    kept = placed.where("uid IS NOT NULL").join(texts, F.col("uid") == F.col("u"))
    kept = kept.select("conv_id", "piece", "place", "turn", F.coalesce("new_role", "role").alias("role"), "text")
    new = placed.where("uid IS NULL").select("conv_id", "piece", "place", F.lit(None).cast("long").alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"))
    return kept.unionByName(new)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of each conversation's ``role:text``, joined by line ends; streamed, whatever its length."""
    ddl = "conv_id long, sha256 string"
    schema = _arrow_schema(ddl)
    lines = turns.select("conv_id", "piece", "place", F.concat("role", F.lit(":"), "text").alias("line"))

    def stream(batches):
        state, conv, out = None, None, []
        for batch in batches:
            for conv_id, line in zip(batch["conv_id"].to_pylist(), batch["line"].to_pylist()):
                if state is None or conv_id != conv:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    state, conv = sha256(), conv_id
                else:
                    state.update(b"\n")
                state.update(line.encode("utf-8", "surrogatepass"))
            if len(out) > 1000:
                yield _arrow_rows(out, schema)
                out = []
        if state is not None:
            yield _arrow_rows([*out, (conv, state.hexdigest())], schema)

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "place").mapInArrow(stream, ddl)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults, by the checksum of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties it, 2 takes its stops, 3 repeats
    it, 4 makes it a user's; nulls count as one blank."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = (F.crc32(F.concat(known[0], F.lit(":"), known[1])) % 20).alias("kind")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role")
    rows = conversations.select("conv_id", "turn", known[2].alias("role"), known[3].alias("text"), kind).where("kind <> 0")
    rows = rows.select("conv_id", "turn", role, text, F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")
