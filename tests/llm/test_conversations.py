"""Conversation repair against every sequence of edits, and against a plain restatement on whole tables."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from stowage.llm import conversations, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile("(s?(ua)+)?")
ROLE = {"u": "user", "a": "assistant"}


def damage(rows):
    """Rows by conversation after damage, in order."""
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, kind = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        own = found[conv]
        if kind:
            own += [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in found.items()}


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def choices(row, fault):
    _, role, text = row
    yield "D", 2, None
    if fault not in ("blank", "duplicate"):
        more = 5 if fault == "truncated" else 0
        if role:
            yield "K", more, (role, text)
        yield "R", 1 + more, ("user", text)
        yield "R", 1 + more, ("assistant", text)


def every(rows):
    """Cost, audit and outcome of the best of all sequences of edits with up to two insertions in a gap."""
    gaps = [(), *itertools.product("ua", repeat=1), *itertools.product("ua", repeat=2)]
    gaps = [[("I", 5, (ROLE[c], "")) for c in g] for g in gaps]
    own = [list(choices(r, f)) for r, f in zip(rows, faults(rows), strict=True)]
    best = None
    for picks in itertools.product(*(x for o in own for x in (gaps, [[c] for c in o])), gaps):
        edits = [e for p in picks for e in p]
        if GOOD.fullmatch("".join(e[2][0][:1] for e in edits if e[2])):
            now = sum(e[1] for e in edits), "".join(e[0] for e in edits), [e[2] for e in edits if e[2]]
            best = now if best is None or now < best else best
    return best


def restated(rows):
    """The same by recursion over rows and states, with costs and texts in pairs."""
    own, step = list(zip(rows, faults(rows), strict=True)), {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, inserted=0):
        found = []
        if i == len(own):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            for letter, cost, out in choices(*own[i]):
                to = step.get((state, out[0][:1])) if out else state
                if to is not None and (rest := best(i + 1, to)):
                    found.append((cost + rest[0], letter + rest[1], ((out,) if out else ()) + rest[2]))
        if inserted < 2:
            for c in "ua":
                if (to := step.get((state, c))) and (rest := best(i, to, inserted + 1)):
                    found.append((5 + rest[0], "I" + rest[1], ((ROLE[c], ""), *rest[2])))
        return min(found, default=None)

    return best(0, "")


def expected(rows, solve=restated):
    out = {}
    for conv, own in damage(rows).items():
        kinds, turns = collections.Counter(faults(own)), sorted({r[0] for r in own if r[0] is not None})
        cost, audit, kept = solve(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, digest)
    return out


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def some(rng, convs, most):
    texts = ["Yes.", "no", "", " ", "Why? ", "so.\n", "Yes.", "a!b"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "u", "Ä"]
    return [(c, t, rng.choice(roles), rng.choice([*texts, None])) for c in range(convs) for t in range(rng.randrange(1, most + 1))]


def test_weights_find_the_best_of_all_edits(spark):
    rng = random.Random(5)
    rows = some(rng, 40, 3)
    assert expected(rows, every) == expected(rows) == found(conversations.repair_damaged(spark.createDataFrame(rows, SCHEMA)))


def test_chained_tables_are_whole_solutions():
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randrange(1, 40))]
        whole = conversations._least(conversations.solve(rows, conversations.ACCEPTED)[0])
        paths, digits, at = None, 0, 0
        while at < len(rows):
            part = rows[at : at + rng.randrange(1, 9)]
            own, more = conversations.table(part), conversations.width(len(part))
            paths = own[0] if paths is None else conversations.chained(paths, digits, own, more)
            digits, at = digits + more, at + len(part)
        best = min(paths[s] for s in conversations.ACCEPTED if paths[s] is not None)
        assert conversations.told(best, digits) == conversations.told(whole, conversations.width(len(rows)))


@pytest.mark.parametrize("block", [3, 1024])
def test_long_conversation_over_many_tasks(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(7)
    roles, texts = ["user", "assistant"] * 3 + ["system", ""], ["One.", "two", "", "Three!", "Four?"]
    rows = [(1, t if rng.random() < 0.9 else t // 7, rng.choice(roles), f"{rng.choice(texts)}{rng.randrange(150) if rng.random() < 0.5 else ''}") for t in range(600)]
    rows += [(c, t, rng.choice(roles), rng.choice(texts)) for c in (0, 2, 3) for t in range(5)] + [(1, None, "user", "One.")] * 3
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(conversations.repair_damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_awkward(spark):
    long = "word " * 200_000
    rows = [
        (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "assistant", "Hi."), (1, None, None, None), (None, None, "user", "Ok?"), (None, 3, "assistant", "Ok!"), (2, 5, "", "x."), (2, 6, "Äu", "日本語。"),
        (3, -(1 << 63), "user", long), (3, (1 << 63) - 1, "assistant", long + "."), (4, 1, "system", "S."), (4, 2, "user", "U."), (-5, 1, "user", "a\\b\"c."), (-5, 2, "assistant", " ."),
    ]
    wanted = expected(rows)
    wanted[3] = (min(wanted[3][0], (1 << 63) - 1), *wanted[3][1:])
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", cost long, `a.b` string, fault string")
    assert found(conversations.repair_damaged(docs)) == wanted
    assert conversations.repair_damaged(docs.limit(0)).count() == 0
    # a conversation of which all rows are dropped
    gone = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(conversations.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_query_equals_restatement(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{DATA}/conversations.parquet'").fetchall()
    assert found(queries.QUERIES["op12_conversation_repair"](spark, DATA)) == expected(rows)
