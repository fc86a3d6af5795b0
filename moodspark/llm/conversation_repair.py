"""Repair of conversation structure with a persistent audit DP.

The roles of a repaired conversation spell ``(s?(ua)+)?``. A small automaton has
four states: nothing yet, after s, after u, after a. Rows are read in order; for
each state the DP keeps the cheapest edits that lead there, as an audit with one
letter an edit (Keep, Rerole, Delete, Insert). Of equally cheap audits the one that
is least in ASCII order counts.

Audits are not strings but nodes that share their prefixes: a node is a letter
and a parent, with binary-lifting ancestors and a rolling hash of the audit up
to it. Two audits of equal cost are compared by a search for their longest
common prefix along the ancestors, and equal hashes of different nodes are
verified letter by letter. When all audits that can still win share a prefix,
it is written out and their nodes start anew, so a long conversation holds
only what is undecided.

An audit tells its cost, so of two equally cheap audits of the same rows neither
is a proper prefix of the other, and the least prefix gives the least whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

WHITE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
CUT = 3                                     # added for a truncated row that stays
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
START, S, U, A = range(4)
_NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
_ADDED = (U, U, A, U)                       # state after the one role that may be inserted or given, by state
_LEGAL = {"su", "ua", "au"}
_ROLE = {U: "user", A: "assistant"}
BASE, MOD = 131, (1 << 61) - 1
NODES = 4096


class Audits:
    """Audits as nodes of shared prefixes; node 0 is the empty audit."""

    def __init__(self, mod: int = MOD):
        self.mod, self.same = mod, set()
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, parent: int, letter: str) -> int:
        ancestors, k = [parent], 0
        while k < len(self.up[ancestors[k]]):
            ancestors.append(self.up[ancestors[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(letter)) % self.mod)
        self.up.append(tuple(ancestors))
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def text(self, node: int, above: int = 0) -> str:
        """The letters after ``above``, an ancestor."""
        out = []
        while node != above:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def equal(self, a: int, b: int) -> bool:
        """Whether two audits of one length are equal: their letters are compared up to where they meet, once a pair."""
        met, x, y = (a, b), a, b
        while x != y and (x, y) not in self.same:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        self.same.add(met)
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether the audit of ``x`` comes before that of ``y`` in ASCII order."""
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if a == b or self.hash[a] == self.hash[b] and self.equal(a, b):
            return self.depth[x] < self.depth[y]
        if self.hash[a] != self.hash[b]:
            # the highest ancestors that differ stand right after the longest common prefix
            c, d = a, b
            for k in reversed(range(len(self.up[c]))):
                if k < len(self.up[c]):
                    e, f = self.up[c][k], self.up[d][k]
                    if self.hash[e] != self.hash[f]:
                        c, d = e, f
            if self.equal(self.up[c][0], self.up[d][0]):
                return self.letter[c] < self.letter[d]
        return self.text(a) < self.text(b)         # hashes collided

    def common(self, nodes: list[int]) -> int:
        """The deepest node on the paths to all ``nodes``."""
        a = nodes[0]
        for b in nodes[1:]:
            depth = min(self.depth[a], self.depth[b])
            a, b = self.ancestor(a, depth), self.ancestor(b, depth)
            for k in reversed(range(len(self.up[a]))):
                if k < len(self.up[a]) and self.up[a][k] != self.up[b][k]:
                    a, b = self.up[a][k], self.up[b][k]
            a = a if a == b else self.up[a][0]
        return a


class Repair:
    """Cheapest edits of one conversation, row by row: ``row(initial, fault)`` for each, then ``finish()``."""

    def __init__(self, mod: int = MOD, nodes: int = NODES):
        self.mod, self.limit, self.least = mod, nodes, nodes
        self.audits, self.written = Audits(mod), []
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self._insert(self.best)

    def _offer(self, best: list, state: int, cost: int, parent: int, letter: str) -> None:
        now = best[state]
        if now is None or cost < now[0]:
            best[state] = (cost, self.audits.add(parent, letter))
        elif cost == now[0]:
            node = self.audits.add(parent, letter)
            if self.audits.less(node, now[1]):
                best[state] = (cost, node)

    def _insert(self, best: list) -> None:
        """A row may be inserted in any state: one that leads to u, then one that leads to a."""
        for before, after in ((START, U), (S, U), (A, U), (U, A)):
            if best[before]:
                self._offer(best, after, best[before][0] + COSTS[INSERT], best[before][1], INSERT)

    def row(self, initial: str, fault: int) -> None:
        best: list = [None] * 4
        extra = CUT if fault == TRUNCATED else 0
        for state, found in enumerate(self.best):
            if not found:
                continue
            cost, node = found
            self._offer(best, state, cost + COSTS[DELETE], node, DELETE)
            if fault in (BLANK, DUPLICATE):
                continue
            if (state, initial) in _NEXT:
                self._offer(best, _NEXT[state, initial], cost + COSTS[KEEP] + extra, node, KEEP)
            self._offer(best, _ADDED[state], cost + COSTS[REROLE] + extra, node, REROLE)
        self._insert(best)
        # a state that another one can follow at less cost, whatever comes, can't win: from a, what s or nothing
        # would keep is deleted, and what u would make an a is deleted or not inserted; from u, an a is inserted first
        to = {q: c[0] for q, c in enumerate(best) if c}
        after_a = min(to.get(A, 1 << 60), to.get(U, 1 << 60) + COSTS[INSERT])
        for state, more in ((START, COSTS[DELETE]), (S, 0), (U, COSTS[DELETE])):
            if best[state] and to[state] > after_a + more:
                best[state] = None
        self.best = best
        if len(self.audits.letter) > self.limit:
            self._write_out()

    def _write_out(self) -> None:
        """Write the prefix that all audits share, and copy what is left of them to new nodes."""
        old, live = self.audits, [c for c in self.best if c]
        root = old.common([node for _, node in live])
        self.written.append(old.text(root))
        self.audits, copies = Audits(self.mod), {root: 0}
        for _, node in live:
            path = []
            while node not in copies:
                path.append(node)
                node = old.up[node][0]
            for x in reversed(path):
                copies[x] = self.audits.add(copies[old.up[x][0]], old.letter[x])
        self.best = [(c[0], copies[c[1]]) if c else None for c in self.best]
        self.limit = self.least + 2 * len(copies)

    def finish(self) -> tuple[int, str]:
        """Cost and audit."""
        cost, node = min((c for c in (self.best[START], self.best[A]) if c), key=lambda c: c[0])
        for other, end in (c for c in (self.best[START], self.best[A]) if c):
            if other == cost and self.audits.less(end, node):
                node = end
        return cost, "".join(self.written) + self.audits.text(node)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``(edit, role, text)`` of the repaired rows: the edits of an audit applied to (role, text) in order."""
    rows, state = iter(rows), START
    for edit in audit:
        if edit == INSERT:
            state, text = _ADDED[state], ""
            yield edit, _ROLE[state], text
            continue
        role, text = next(rows)
        if edit == KEEP:
            state = _NEXT[state, role[:1]]
            yield edit, role, text
        elif edit == REROLE:
            state = _ADDED[state]
            yield edit, _ROLE[state], text


def _rows_of(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id, turn, role, text, same``: nulls as one space; ``same`` is a digest of role and text."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    rows = turns.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
                        role_.alias("role"), text_.alias("text"))
    return rows.withColumn("same", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("same")]


def row_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, same, initial, fault`` of each row; texts go no further than here.

    Rows with one digest in one conversation are numbered where they meet, so
    even a conversation that holds a third of all rows is spread over all tasks.
    """
    body = F.btrim("text", F.lit(WHITE))
    blank, cut = body == "", ~F.right(body, F.lit(1)).isin(".", "!", "?")
    facts = rows.select("conv_id", "turn", "same", F.left("role", F.lit(1)).alias("initial"), blank.alias("blank"), cut.alias("cut"))
    again = F.row_number().over(W.partitionBy("conv_id", "same").orderBy(F.col("turn").asc_nulls_first())) > 1
    return facts.withColumn("again", again).select("conv_id", "turn", "same", "initial", F.when(F.col("blank"), BLANK).when(
        F.col("again"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(SOUND).alias("fault"))


AUDIT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
         "audit string")


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a stream of rows in order."""
    names = [c.split()[0] for c in AUDIT.split(", ")]
    done: list[tuple] = []
    key = repair = None
    counts, turns, illegal, last = [0] * 4, [], 0, ""

    def close() -> None:
        if repair:
            cost, audit = repair.finish()
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            done.append((key[0], gaps, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost, audit))

    def flush() -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.string()]
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names)
        done.clear()
        return out

    for batch in batches:
        for conv, turn, initial, fault in zip(*[batch[c].to_pylist() for c in ("conv_id", "turn", "initial", "fault")]):
            if key is None or key[0] != conv:
                close()
                key, repair = (conv,), Repair()
                counts, turns, illegal, last = [0] * 4, [], 0, None
            counts[fault] += 1
            if last is not None and last + initial not in _LEGAL:
                illegal += 1
            last = initial
            if turn is not None:
                if not turns:
                    turns = [turn, turn, 1]             # least, largest, distinct
                elif turn != turns[1]:
                    turns = [turns[0], turn, turns[2] + 1]
            repair.row(initial, fault)
        if done:
            yield flush()
    close()
    yield flush()


def audits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    Rows count by turn, nulls first; rows of one turn in the order of a digest of
    role and text, so that equal rows stand together. Null roles and texts count
    as one space, null ids are one conversation. A role is known by its first
    letter; a row whose role is empty or starts with another letter than s, u
    and a can't be kept. Repeated rows are duplicates. Further columns are not
    read; an empty table gives no rows.
    """
    rows = _rows_of(turns, conv_col, turn_col, role_col, text_col)
    return row_faults(rows).repartition("conv_id").sortWithinPartitions(*_order()).select(
        "conv_id", "turn", "initial", "fault").mapInArrow(_audits, AUDIT)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """For each conversation its audit row and an iterator over its (role, text), read as they come."""
    rows = (r for batch in batches for r in batch.to_pylist())
    head = next(rows, None)
    while head is not None:
        following: list[dict] = []

        def own() -> Iterator[tuple[str, str]]:
            for r in rows:
                if r["audit"] is not None:
                    following.append(r)
                    return
                yield r["role"], r["text"]

        mine = own()
        yield head, mine
        for _ in mine:
            pass
        head = following[0] if following else None


def _with_audits(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's audit row, then its rows, in the order in which they were audited."""
    both = found.unionByName(rows, allowMissingColumns=True).withColumn("head", F.col("audit").isNull())
    order = _order()
    return both.repartition("conv_id").sortWithinPartitions(order[0], F.col("head"), *order[1:])


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The rows of :func:`audits` and ``repaired_sha256``, of the repaired ``role:text`` joined by newlines.

    Audits and texts are sent to one place per conversation and hashed as they
    stream by in order: a task holds an audit and one batch of rows, never a
    whole conversation's texts.
    """
    rows = _rows_of(turns, conv_col, turn_col, role_col, text_col)
    found = materialize(audits(turns, conv_col, turn_col, role_col, text_col), "audits")
    names = [c.split()[0] for c in AUDIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], pa.string() if k > 6 else pa.int64())
                                              for k, c in enumerate([*names, "repaired_sha256"])], [*names, "repaired_sha256"])
            done.clear()
            return out

        for head, own in _streams(batches):
            digest, line = hashlib.sha256(), ""
            for _, role, text in edited(head["audit"], own):
                digest.update(f"{line}{role}:{text}".encode("utf-8", "surrogatepass"))
                line = "\n"
            done.append(head | {"repaired_sha256": digest.hexdigest()})
            if len(done) >= 1000:
                yield flush()
        yield flush()

    return _with_audits(found, rows).select(*names, "role", "text").mapInArrow(run, f"{AUDIT}, repaired_sha256 string")


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """The repaired conversations: ``conv_id, place`` (from 0), ``role, text, edit``."""
    rows = _rows_of(turns, conv_col, turn_col, role_col, text_col)
    found = materialize(audits(turns, conv_col, turn_col, role_col, text_col), "audits")
    names = ["conv_id", "place", "role", "text", "edit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, own in _streams(batches):
            out: list[tuple] = []
            for place, (edit, role, text) in enumerate(edited(head["audit"], own)):
                out.append((head["conv_id"], place, role, text, edit))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                        ("edit", pa.string())])
    return _with_audits(found, rows).select("conv_id", "audit", "role", "text").mapInArrow(
        run, "conv_id bigint, place bigint, role string, text string, edit string")
