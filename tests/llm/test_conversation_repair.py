"""Conversation repair: the DP against an exhaustive search, audits as nodes against strings, the query against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from moodspark.llm import conversation_repair as cr
from moodspark.llm import queries

SHAPE = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, same string, head boolean, audit string, kind int, fault string"


def search(rows):
    """All edits of each row and up to two insertions before and after it, by strings."""
    best = {"": (0, "", ())}

    def inserted(found):
        for _ in range(2):
            for roles, (cost, audit, out) in list(found.items()):
                for c in "ua":
                    offer(found, roles + c, cost + 3, audit + "I", (*out, ("assistant" if c == "a" else "user", "")))
        return found

    def offer(found, roles, cost, audit, out):
        if re.fullmatch(r"s?(ua)*u?", roles) and (roles not in found or (cost, audit) < found[roles][:2]):
            found[roles] = (cost, audit, out)

    best = inserted(best)
    for role, text, fault in rows:
        after = {}
        for roles, (cost, audit, out) in best.items():
            offer(after, roles, cost + 4, audit + "D", out)
            if fault not in (cr.BLANK, cr.DUPLICATE):
                extra = 3 * (fault == cr.TRUNCATED)
                if role[:1] in tuple("sua"):
                    offer(after, roles + role[:1], cost + extra, audit + "K", (*out, (role, text)))
                for new in ("user", "assistant"):
                    offer(after, roles + new[0], cost + 3 + extra, audit + "R", (*out, (new, text)))
        best = inserted(after)
    return min(v for k, v in best.items() if SHAPE.fullmatch(k))


def solved(rows, **how):
    repair = cr.Repair(**how)
    for role, _, fault in rows:
        repair.row(role[:1], fault)
    return repair.finish()


def random_rows(rng, n, roles=("user", "assistant", "system", "tool", "", "u")):
    return [(rng.choice(roles), f"t{k}", rng.choice([0, 0, 0, 1, 2, 3])) for k in range(n)]


@pytest.mark.parametrize("how", [{}, {"mod": 1}, {"mod": 2}, {"nodes": 1}, {"mod": 1, "nodes": 8}])
def test_cost_audit_and_repair_equal_an_exhaustive_search(how):
    rng = random.Random(1)
    cases = [random_rows(rng, n) for n in range(7) for _ in range(25)]
    cases += [[(r, "x", f) for r, f in zip(rs, fs)] for rs in itertools.product(["user", "assistant", "system"], repeat=3)
              for fs in itertools.product([0, 3], repeat=3)]
    for rows in cases:
        cost, audit, out = search(rows)
        assert solved(rows, **how) == (cost, audit), rows
        assert [x[1:] for x in cr.edited(audit, ((r, t) for r, t, _ in rows))] == list(out)


def by_strings(rows):
    """The same DP with audits as strings: a plain check for longer conversations."""
    best = {0: (0, "")}

    def close(b):
        for p, q in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if p in b:
                b[q] = min(b.get(q, (1 << 60, "")), (b[p][0] + 3, b[p][1] + "I"))
        return b

    best = close(best)
    for role, _, fault in rows:
        new = {}
        for q, (c, s) in best.items():
            moves = [(q, c + 4, "D")]
            if fault in (0, 3):
                moves += [({0: 2, 1: 2, 2: 3, 3: 2}[q], c + 3 + fault, "R")]
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, role[:1]))
                moves += [(to, c + fault, "K")] if to else []
            for to, cost, letter in moves:
                new[to] = min(new.get(to, (1 << 60, "")), (cost, s + letter))
        best = close(new)
    return min(best[q] for q in (0, 3) if q in best)


def test_long_conversations_stay_small_and_equal_plain_strings():
    rng = random.Random(5)
    for roles in (("user",), ("user", "assistant"), ("assistant", "system"), ("user", "assistant", "system", "tool")):
        rows = random_rows(rng, 1500, roles)
        repair, most = cr.Repair(nodes=64), 0
        for role, _, fault in rows:
            repair.row(role[:1], fault)
            most = max(most, len(repair.audits.letter))
        assert repair.finish() == by_strings(rows) and most < 1200


def test_nodes_compare_as_strings():
    rng = random.Random(2)
    for mod in (cr.MOD, 7, 1):
        store, texts = cr.Audits(mod), [""]
        for _ in range(200):
            parent, letter = rng.randrange(max(0, len(texts) - 30), len(texts)), rng.choice("DI")
            texts.append(texts[parent] + letter)
            assert store.add(parent, letter) == len(texts) - 1
        for _ in range(800):
            x, y = rng.randrange(201), rng.randrange(201)
            assert store.less(x, y) == (texts[x] < texts[y])
            c = store.common([x, y])
            assert texts[x].startswith(texts[c]) and texts[y].startswith(texts[c]) and store.text(x) == texts[x]


def plain(rows):
    """Rows after damage: the contract's result by conversation, in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = (" " if role is None else role), (" " if text is None else text)
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        # equal turns: by the operator's digest
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in mine:
            body = text.strip(" \t\n\x0b\f\r")
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in {"su", "ua", "au"} for a, b in zip(mine, mine[1:]))
        cost, audit = by_strings([(r, t, f) for (_, r, t), f in zip(mine, faults)])
        lines = [f"{r}:{t}" for _, r, t in cr.edited(audit, ((r, t) for _, r, t in mine))]
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", True, "clash", 9, "clash") for r in rows], SCHEMA)


def test_query_equals_plain_python_on_the_given_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in queries.table(spark, sf, "conversations").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11(spark, sf).collect()}
    assert got == plain(rows)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    texts = ["Fine.", "no end", "", None, " \t\n", "Why?!", "é ñ 🙂.", "a\x00b.", "x" * 200_000, "\xa0", "Fine."]
    rows = [(rng.choice([None, 1, 2, 3, -4, 77]), rng.choice([None, 0, 1, 2, 2, 5, 9]),
             rng.choice(["user", "assistant", "system", None, "", "USER", "🙂"]), rng.choice(texts)) for _ in range(120)]
    rows += [(500 + k, k % 3, "user", "Hello.") for k in range(60)]             # some lose their only row
    rows += [(9000, k, ("user", "assistant")[k % 2], "word " * (k % 5) + "end.") for k in range(3000)]    # a long one
    frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11(spark, str(tmp_path)).collect()}
    want = plain(rows)
    assert got == want
    empty = hashlib.sha256(b"").hexdigest()
    assert any(v == (0, 0, 0, 0, 0, 0, "", empty) for v in want.values())


def test_repaired_turns_are_legal_and_whole(spark):
    rng = random.Random(9)
    rows = [(k // 7, k % 7, rng.choice(["user", "assistant", "system"]), f"text {k}.") for k in range(140)]
    found = {}
    for r in sorted(cr.repaired_turns(frame(spark, rows)).collect(), key=lambda r: (r.conv_id, r.place)):
        found.setdefault(r.conv_id, []).append(r)
    hashes = {r.conv_id: r.repaired_sha256 for r in cr.repair(frame(spark, rows)).collect()}
    assert set(hashes) == {k // 7 for k in range(140)}
    for conv, mine in found.items():
        assert [r.place for r in mine] == list(range(len(mine)))
        assert SHAPE.fullmatch("".join(r.role[0] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == hashes[conv]


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11(spark, str(tmp_path)).collect() == []
    assert cr.repaired_turns(frame(spark, [])).collect() == []
