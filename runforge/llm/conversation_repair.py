r"""Conversation structure repair: the cheapest edits that make every conversation follow the role grammar.

A repaired conversation is empty, or an optional system turn and then user and assistant
turns in pairs. Each row is kept (cost 0), given the role that the grammar wants (2) or
deleted (3; blank rows and repeats must be); empty turns may be inserted anywhere (2); a
truncated row that stays costs 1 more. The audit is the string of the edits' initials, of
the cheapest ones the least in ASCII order.

1. Equal rows of a turn become one row with a number (so a row repeated millions of times
   is one), the first place of each (role, text) comes from a grouping, and the rows are
   sorted over all tasks by ranges of (conversation, turn, role, text), stored once, and
   numbered. The rows of a conversation in one run of 4,096 numbers are a chunk; nothing is
   ever grouped beyond a chunk, except one small row a chunk.
2. A row's symbol says its role's initial and its fault, a chunk's symbols are its
   signature. Distinct signatures of all conversations are sorted by their reverse, over
   all tasks: neighbours share their ends, so a stack of the current suffix is an
   automaton whose nodes each stand for one distinct suffix (:class:`Suffixes`). A node's
   cost-to-go, and its best edit for each grammar state, are computed once; as they depend
   only on the symbol and on the differences of the next node's costs, equal ones are one
   state of the minimised automaton. Among equal costs the edit of least initial is the
   least audit, since different edits have different initials.
3. A conversation of several chunks first composes its chunks' cost matrices from its end
   (:func:`continuations`), which gives each chunk the cost-to-go after it; signature and
   that vector together are what is looked up.
4. Audits meet the texts in order of place. A digest of a whole conversation reads its
   texts in order, so one task streams them, in bounded memory; the repaired turns
   themselves (:func:`repaired_turns`) are made chunk by chunk.

Cases: null roles and texts are one space; rows of null turns come first, rows of one turn
are ordered by role, then text; a null conversation id is a conversation of its own.
Repeated rows are duplicates. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runforge.llm.common import prepare
from runforge.session import materialize

#: The characters that are no content: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\f\r"
#: Rows of a chunk, as a power of two.
CHUNK_BITS = 12
#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = range(4)
FAR = 1 << 60
#: Next state for a role's initial, and for an inserted or rerolled turn.
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
TURN = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}


def damage(df: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as a seeded fault leaves them: dropped, emptied, cut, repeated or renamed."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = df.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"),
                     (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("_k"))
    text = (F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (rows.where("_k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_t"))
            .drop("_t"))


def key_of(column: Column) -> Column:
    """A conversation's id as text, null or not."""
    return F.when(column.isNull(), "-").otherwise(F.concat(F.lit("+"), column.cast("string")))


def placed(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, turn, role, text, n, no, chunk, faults): a stored row for each distinct row, numbered in order."""
    prepare(df.sparkSession)
    rows = df.select(key_of(F.col(conv_col)).alias("c"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    once = materialize(rows.groupBy("c", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
                       .withColumn("sha", F.sha2("text", 256))
                       .withColumn("at", F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))), "turns")
    firsts = materialize(once.groupBy("c", "role", "sha").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))
                         .where("k > 1").drop("k"), "first-turns")
    blank = F.translate("text", WHITE, "") == ""
    cut = ~F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1)).isin(".", "!", "?")
    rest = F.coalesce(~F.col("at").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    faulty = (once.join(firsts, ["c", "role", "sha"], "left")
              .select("c", "turn", "role", "text", "n", blank.alias("blank"), cut.alias("cut"), rest.alias("rest")))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    number = F.monotonically_increasing_id()
    ordered = materialize(faulty.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("no", number), "placed")
    first = F.substring("role", 1, 1)
    kind = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    kind = F.when(F.col("cut"), F.upper(kind)).otherwise(kind)
    symbols = F.when(F.col("blank") | F.col("rest"), F.repeat(F.lit("x"), F.col("n").cast("int"))) \
        .otherwise(F.concat(kind, F.repeat(F.lit("x"), F.col("n").cast("int") - 1)))
    return (ordered.withColumn("chunk", F.shiftright("no", CHUNK_BITS)).withColumn("initial", first)
            .withColumn("symbols", symbols))


def faults(rows: DataFrame) -> DataFrame:
    """(c, gaps, blank, duplicate, truncated) of each conversation."""
    n = F.col("n")
    again = F.when(F.col("blank"), 0).when(F.col("rest"), n).otherwise(n - 1)
    short = F.when(~F.col("blank") & ~F.col("rest") & F.col("cut"), 1).otherwise(0)
    by_turn = rows.groupBy("c", "turn").agg(F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
                                            F.sum(again).alias("duplicate"), F.sum(short).alias("truncated"))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return by_turn.groupBy("c").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
                                    *[F.sum(x).cast("long").alias(x) for x in ("blank", "duplicate", "truncated")])


def signatures(rows: DataFrame) -> DataFrame:
    """(c, chunk, sig, illegal, last, many): a row a chunk; ``last`` the conversation's last, ``many`` if it has several."""
    from pyspark.sql import Window
    inside = Window.partitionBy("c", "chunk").orderBy("no")
    pair = F.concat(F.lag("initial").over(inside), F.col("initial"))
    wrong = F.coalesce((~pair.isin("su", "ua", "au")).cast("long"), F.lit(0)) + F.col("n") - 1
    chunks = (rows.select("c", "chunk", "no", "symbols", "initial", wrong.alias("wrong"))
              .groupBy("c", "chunk").agg(F.array_sort(F.collect_list(F.struct("no", "symbols"))).alias("all"),
                                         F.sum("wrong").alias("wrong"), F.min_by("initial", "no").alias("head"),
                                         F.max_by("initial", "no").alias("tail")))
    along = Window.partitionBy("c").orderBy("chunk")
    pair = F.concat(F.lag("tail").over(along), F.col("head"))
    between = F.coalesce((~pair.isin("su", "ua", "au")).cast("long"), F.lit(0))
    return chunks.select("c", "chunk", F.array_join(F.transform("all", lambda x: x["symbols"]), "").alias("sig"),
                         (F.col("wrong") + between).alias("illegal"),
                         F.lead("chunk").over(along).isNull().alias("last"), F.lag("chunk").over(along).isNull().alias("first"))


class Suffixes:
    """The automaton: nodes of the current suffix, from its end, and the minimised states they are in."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}

    def end(self) -> tuple:
        """Cost to finish from each grammar state, and the edit that does it."""
        return (0, 4, 2, 0), ("", "I", "I", "")

    def step(self, symbol: str, after: tuple) -> tuple:
        """(costs, edits) before a symbol, from the costs after it; least costs are taken off and added again."""
        low = min(after)
        key = (symbol, *[x - low if x < FAR else FAR for x in after])
        if key not in self.known:
            self.known[key] = self._solve(symbol, key[1:])
        costs, edits = self.known[key]
        return tuple(x + low if x < FAR else FAR for x in costs), edits

    def _solve(self, symbol: str, after: tuple) -> tuple:
        low = symbol.lower()
        more = int(symbol != low)
        best: list[tuple[int, str]] = []
        for s in STATES:
            ways = [(3 + after[s], "D")]
            if low != "x":
                ways.append((2 + more + after[TURN[s]], "R"))
                if s in KEEP[low]:
                    ways.append((more + after[KEEP[low][s]], "K"))
            best.append(min(ways))
        for _ in STATES:  # an inserted turn comes before the row, and may come before another
            best = [min(best[s], (2 + best[TURN[s]][0], "I")) for s in STATES]
        return tuple(min(x, FAR) for x, _ in best), tuple(e for _, e in best)

    def suffixes(self, last: tuple, signatures: Iterator[str]) -> Iterator[list[tuple]]:
        """For each signature the (costs, edits) of its suffixes, the shortest first; shared ends are kept from the one before."""
        nodes, before = [last], ""
        for sig in signatures:
            shared, most = 0, min(len(sig), len(before))
            while shared < most and sig[-1 - shared] == before[-1 - shared]:
                shared += 1
            del nodes[shared + 1:]
            for symbol in reversed(sig[:len(sig) - shared]):
                nodes.append(self.step(symbol, nodes[-1][0]))
            before = sig
            yield nodes


def walk(sig: str, nodes: list[tuple], state: int, ended: bool) -> tuple[str, int]:
    """The audit from a grammar state on, and the state after it; ``ended``: also what is inserted at the end."""
    out: list[str] = []
    for k, symbol in enumerate(sig):
        edits = nodes[len(sig) - k][1]
        while (edit := edits[state]) == "I":
            out.append(edit)
            state = TURN[state]
        out.append(edit)
        state = state if edit == "D" else TURN[state] if edit == "R" else KEEP[symbol.lower()][state]
    while ended and (edit := nodes[0][1][state]) == "I":
        out.append(edit)
        state = TURN[state]
    return "".join(out), state


def matrices(sigs: DataFrame) -> DataFrame:
    """(sig, m): 16 least costs of each signature, from a state before it to one after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Suffixes()
        for batch in batches:
            names = batch.column(0).to_pylist()
            columns = []
            for t in STATES:
                last = (tuple(0 if s == t else FAR for s in STATES), ("",) * 4)
                columns.append([nodes[-1][0] for nodes in automaton.suffixes(last, iter(names))])
            m = [[columns[t][k][s] for s in STATES for t in STATES] for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m, pa.list_(pa.int64()))], names=["sig", "m"])

    return _by_ends(sigs.select("sig").distinct()).mapInArrow(run, "sig string, m array<long>")


def _by_ends(sigs: DataFrame) -> DataFrame:
    """Sorted by the reversed signature over all tasks."""
    parts = max(int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [c for c in sigs.columns if c != "sig"] + [F.reverse("sig")]
    return sigs.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def continuations(chunks: DataFrame) -> DataFrame:
    """(c, chunk, after) of the chunks (c, chunk, m) of long conversations: costs after each, least taken off."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk", ascending=False)
        after, out = Suffixes().end()[0], []
        for m in rows["m"]:
            low = min(after)
            out.append([int(x - low) for x in after])
            after = [min(m[4 * s + t] + after[t] for t in STATES) for s in STATES]
        return pd.DataFrame({"c": rows["c"], "chunk": rows["chunk"], "after": out})

    return chunks.groupBy("c").applyInPandas(run, "c string, chunk long, after array<long>")


def best_edits(asked: DataFrame) -> DataFrame:
    """(sig, after, audits, ends, costs) of each distinct (sig, after), by state before it; a null ``after`` is the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, held, nodes = Suffixes(), None, None
        for batch in batches:
            audits, ends, costs = [], [], []
            for after, sig in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if nodes is None or after != held:
                    held = after
                    last = automaton.end() if after is None else (tuple(after), ("",) * 4)
                    waiting: list[str] = []
                    nodes = automaton.suffixes(last, iter(waiting.pop, None))
                waiting.append(sig)
                own = next(nodes)
                told = [walk(sig, own, s, after is None) for s in STATES]
                audits.append([a for a, _ in told])
                ends.append([e for _, e in told])
                costs.append([own[-1][0][s] - (0 if after is None else own[0][0][e]) for s, (_, e) in zip(STATES, told)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32())),
                 pa.array(costs, pa.list_(pa.int64()))], names=["sig", "after", "audits", "ends", "costs"])

    return _by_ends(asked.select("after", "sig").distinct()).mapInArrow(
        run, "sig string, after array<long>, audits array<string>, ends array<int>, costs array<long>")


def entry_states(chunks: DataFrame) -> DataFrame:
    """(c, chunk, state): the grammar state before each chunk (c, chunk, ends) of long conversations."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, state, out = rows.sort_values("chunk"), 0, []
        for ends in rows["ends"]:
            out.append(state)
            state = int(ends[state])
        return pd.DataFrame({"c": rows["c"], "chunk": rows["chunk"], "state": out})

    return chunks.groupBy("c").applyInPandas(run, "c string, chunk long, state int")


def decisions(rows: DataFrame) -> DataFrame:
    """(c, chunk, state, audit, cost, illegal): a stored row for each chunk of :func:`placed` rows."""
    chunks = materialize(signatures(rows), "signatures")
    long = chunks.where("not (first and last)")
    after = continuations(long.join(matrices(long), "sig").select("c", "chunk", "m"))
    known = materialize(chunks.where("first and last").withColumn("after", F.lit(None).cast("array<long>"))
                        .unionByName(long.join(after, ["c", "chunk"])
                                     .withColumn("after", F.when(~F.col("last"), F.col("after")))), "continued")
    edits = materialize(best_edits(known), "edits")
    same = (F.col("k.sig") == F.col("e.sig")) & F.col("k.after").eqNullSafe(F.col("e.after"))
    told = materialize(known.alias("k").join(edits.alias("e"), same)
                       .select("k.c", "k.chunk", "k.illegal", "k.first", "k.last", "e.audits", "e.ends", "e.costs"), "told")
    state = entry_states(told.where("not (first and last)").select("c", "chunk", "ends"))
    started = (told.where("first and last").withColumn("state", F.lit(0))
               .unionByName(told.where("not (first and last)").join(state, ["c", "chunk"])))
    return materialize(started.select("c", "chunk", "state", F.col("audits")[F.col("state")].alias("audit"),
                                      F.col("costs")[F.col("state")].alias("cost"), "illegal"), "decisions")


def _edited(rows: DataFrame, decided: DataFrame, by: list[str]) -> DataFrame:
    """Each chunk's decision, then its rows in order; equal values of ``by`` share a task."""
    none = F.lit(None)
    heads = decided.select("c", "chunk", F.lit(-1).cast("long").alias("no"), none.cast("string").alias("role"),
                           none.cast("string").alias("text"), none.cast("long").alias("n"), "state", "audit")
    own = rows.select("c", "chunk", "no", "role", "text", "n", none.cast("int").alias("state"), none.cast("string").alias("audit"))
    return heads.unionByName(own).repartition(*by).sortWithinPartitions("c", "chunk", "no")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(c, chunk, edit, role, text) of every edit but deletions, in order; (c, None, ...) opens a conversation."""
    c = chunk = None
    audit, at, state = "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, TURN[state]
            yield c, chunk, "I", ROLE[state], ""

    for batch in batches:
        for r in batch.to_pylist():
            if r["no"] < 0:
                yield from inserted()  # what the chunk before ends with
                if r["c"] != c:
                    yield r["c"], None, "", "", ""
                c, chunk, audit, at, state = r["c"], r["chunk"], r["audit"], 0, r["state"]
                continue
            for _ in range(r["n"]):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = KEEP[r["role"][0]][state]
                    yield c, chunk, "K", r["role"], r["text"]
                elif edit == "R":
                    state = TURN[state]
                    yield c, chunk, "R", ROLE[state], r["text"]
    yield from inserted()


def repaired_turns(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """(c, chunk, place, edit, role, text): the repaired conversations, ordered by (chunk, place); chunks fill all tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, place = [], None, 0
        names = ["c", "chunk", "place", "edit", "role", "text"]

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*held), (
                pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=names)

        for c, chunk, edit, role, text in edited(batches):
            if chunk is None:
                continue
            place = place + 1 if (c, chunk) == before else 0
            before = c, chunk
            held.append((c, chunk, place, edit, role, text))
            if len(held) >= 500:
                yield made()
                held.clear()
        if held:
            yield made()

    return _edited(rows, decided, ["c", "chunk"]).mapInArrow(run, "c string, chunk long, place long, edit string, role string, text string")


def repaired_digests(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """(c, repaired_sha256): digest of the repaired ``role:text``, joined by line breaks; texts stream through it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, str]] = []
        c, digest, empty = None, None, True

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([y for _, y in done], pa.string())],
                                              names=["c", "repaired_sha256"])

        for own, chunk, _, role, text in edited(batches):
            if chunk is None:
                if digest is not None:
                    done.append((c, digest.hexdigest()))
                c, digest, empty = own, hashlib.sha256(), True
                if len(done) >= 4096:
                    yield made()
                    done.clear()
                continue
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False
        if digest is not None:
            done.append((c, digest.hexdigest()))
        if done:
            yield made()

    return _edited(rows, decided, ["c"]).mapInArrow(run, "c string, repaired_sha256 string")


def repair(original: DataFrame, df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Fault counts, cost, audit and digest of each conversation of ``original``, whose rows are now ``df``."""
    rows = placed(df, conv_col, turn_col, role_col, text_col)
    decided = decisions(rows)
    whole = (decided.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("chunk", "audit"))).alias("all"),
                                      F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
             .select("c", "cost", "illegal", F.array_join(F.transform("all", lambda x: x["audit"]), "").alias("audit")))
    every = original.select(F.col(conv_col).alias(conv_col)).distinct().withColumn("c", key_of(F.col(conv_col)))
    told = every.join(faults(rows), "c", "left").join(whole, "c", "left").join(repaired_digests(rows, decided), "c", "left")
    zero = F.lit(0).cast("long")
    return told.select(conv_col, *[F.coalesce(x, zero).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                       F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
