"""Quotes of every level and length link; generated threads against SQL and brute force."""

import random
import re

import duckdb

from versight.llm import quotations

MESSAGES = "conv_id long, turn long, role string, text string"
MARK = re.compile(r"\A(?:[ \t]*>)+[ \t]?")


def threads(n, seed):
    """Conversations whose messages quote earlier ones, with marks of what these quote, at random."""
    rng = random.Random(seed)
    words = ["tide", "Harbour", "ice", "lantern", "ship", "7", "...", "storm", "rope"]
    rows = []
    for conv in range(n):
        said = []
        for turn in range(rng.randint(1, 9)):
            lines = []
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                if said:
                    mark = rng.choice([">", "> ", " >", ">\t"])
                    lines += rng.choice([[], ["On Monday Bob wrote:"]]) + [mark + x for x in rng.choice(said).split("\n")]
                    lines += rng.choice([[], [""]])
            lines += [" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(rng.randint(0, 3))]
            said.append("\n".join(lines))
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), said[-1]))
    return rows + rows[:3] + [(None, 0, "user", "> tide"), (0, None, "user", "> tide"), (1, 99, "user", None)]


def passages(text):
    """(lines, passages) with levels; a loop over the lines."""
    lines = []
    for raw in text.split("\n"):
        m = MARK.match(raw)
        lines.append([m[0].count(">") if m else 0, raw[m.end() if m else 0 :]])
    for i, (level, line) in enumerate(lines[:-1]):
        if level == 0 and lines[i + 1][0] > 0 and re.fullmatch(r"(?i)[ \t]*on .+ wrote[ \t]*:[ \t\r]*", line):
            lines[i][0] = -1
    out, run = [], None
    for level, line in lines:
        norm = " ".join(line.lower().split())
        if norm and run and run[0] == level and run[2]:
            run[1].append(norm)
        elif norm:
            run = [level, [norm], True]
            out.append(run)
        if run:
            run[2] = bool(norm)
        out.append([level, [norm], True])
    found = {(level, " ".join(x)) for level, x, _ in out}
    return lines, {(level, x) for level, x in found if re.search(r"[^\W_]", x)}


def brute_parents(rows):
    said, parents = {}, {}
    for conv, turn, _, text in sorted(((c, t, r, x or "") for c, t, r, x in rows if c is not None and t is not None), key=lambda r: r[:2]):
        for level, x in sorted(passages(text)[1]):
            if level == 0:
                said.setdefault((conv, x), turn)
    for conv, turn, _, text in rows:
        if conv is not None and turn is not None:
            met = [(level, -said[conv, x]) for level, x in passages(text or "")[1] if level > 0 and said.get((conv, x), turn) < turn]
            if met:
                parents[conv, turn] = -min(met)[1]
    return parents


def test_generated_threads(spark):
    rows = threads(120, 3)
    df = spark.createDataFrame(rows, MESSAGES)
    got = quotations.link_quotations(df)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    want = con.execute(quotations.oracle())
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    found = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, want.fetchall()))
    parents = brute_parents(rows)
    assert len(parents) > 100
    for conv, turn, *_, parent, root, depth in found:
        assert parent == parents.get((conv, turn))
        at, n = turn, 0
        while (conv, at) in parents:
            at, n = parents[conv, at], n + 1
        assert (root, depth) == (at, n)
    seen = set()
    for r in quotations.reply_ordered(got).collect():
        assert r.parent_turn is None or (r.conv_id, r.parent_turn) in seen
        seen.add((r.conv_id, r.turn))


def test_long_marks_and_clashing_columns(spark):
    rows = [(1, 0, "user", "a word", 1, "x"), (1, 1, "user", ">" * 1_000_000 + " a word", 2, "y"), (1, 2, "user", "> a word" + "\nq" * 20_000, 3, "z")]
    df = spark.createDataFrame(rows, MESSAGES + ", root_turn long, _c string")
    got = {r.turn: (r.parent_turn, r.max_level) for r in quotations.link_quotations(df).collect()}
    assert got == {0: (None, 0), 1: (0, 1_000_000), 2: (0, 1)}


def test_nested_and_short_quotes(spark):
    rows = [
        (1, 0, "user", "the harbour freezes every winter"), (1, 1, "assistant", ">> the harbour freezes every winter\n> a message that is missing\nquite so"),
        (2, 0, "user", "Agreed."), (2, 1, "assistant", "> Agreed.\nfine then"), (2, 2, "user", "> fine then\n> >agreed.\nlast one here"),
        (3, 0, "user", "first of all words"), (3, 1, "user", "second of all words"), (3, 2, "user", ">> second of all words\n> first of all words\nboth"),
        (4, 0, "user", "---"), (4, 1, "user", "> ---\nno word is quoted"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth) for r in quotations.link_quotations(df).collect()}
    assert got[1, 1] == (0, 0, 1)
    assert got[2, 1] == (0, 0, 1) and got[2, 2] == (1, 0, 2)
    assert got[3, 2] == (0, 0, 1)  # the lowest level that links decides
    assert got[4, 1] == (None, 1, 0)
