"""Quotation linking against a plain version in Python."""

import itertools
import random
import re
import textwrap

import duckdb
import pandas as pd
import pytest

from millrace.llm import quotes
from millrace.llm.queries import OP6_SQL

PREFIX = re.compile(r"^[ \t]*(>[ \t>]*)")


def parts(text):
    """(level, kind, words) of each line and each passage."""
    lines = []
    for line in re.split("\r\n?|\n", text or ""):
        m = PREFIX.match(line)
        lines.append((m[1].count(">") if m else 0, re.sub(r"\s+", " ", PREFIX.sub("", line).lower()).strip(" ")))
    out = [(level, 0, words) for level, words in lines if words]
    for (level, there), run in itertools.groupby(lines, lambda x: (x[0], bool(x[1]))):
        if there:
            out.append((level, 1, " ".join(words for _, words in run)))
    return out


def plain(rows):
    """{(conv, turn): (reply_to, thread, depth, position, n_quoted)} of rows (conv, turn, role, text)."""
    wrote, quoted = {}, {}
    for conv, turn, _, text in rows:
        if conv is not None and turn is not None:
            for level, kind, words in parts(text):
                (quoted.setdefault((conv, turn), set()).add((level, kind, words)) if level else wrote.setdefault((conv, kind, words), set()).add(turn))
    parent = {}
    for (conv, turn), found in quoted.items():
        votes = {}
        for level, kind, words in found:
            if earlier := [t for t in wrote.get((conv, kind, words), ()) if t < turn]:
                votes[-level, kind, max(earlier)] = votes.get((-level, kind, max(earlier)), 0) + 1
        if votes:
            parent[conv, turn] = max((outer, kind, n, source) for (outer, kind, source), n in votes.items())[3]
    out, threads = {}, {}
    for conv, turn, _, text in rows:
        at, depth = turn, 0
        while (conv, at) in parent:
            at, depth = parent[conv, at], depth + 1
        threads.setdefault((conv, at), set()).add(turn)
        out[conv, turn] = (parent.get((conv, turn)), at, depth, sum(1 for level, kind, _ in parts(text) if level and not kind))
    whole = lambda conv, turn: conv is not None and turn is not None
    return {(c, t): (r, a, d, sum(x < t for x in threads[c, a]) if whole(c, t) else 0, n) for (c, t), (r, a, d, n) in out.items()}


@pytest.mark.parametrize("turns", [1024, 4])
def test_threads(spark, turns, monkeypatch):
    monkeypatch.setattr(quotes, "TURNS", turns)
    rng = random.Random(8)
    rows = []
    for conv in range(6):
        said = {}
        for turn in range(14 if conv else 60):
            lines = []
            for _ in range(rng.randrange(3) if turn else 0):
                source = rng.choice(list(said))
                lines += [f"On Monday user{source} wrote:"] * (rng.random() < 0.5)
                quoted = said[source]
                if rng.random() < 0.3:  # wrapped anew, or in part
                    quoted = " ".join(quoted).split(" ") if rng.random() < 0.5 and not any(x.startswith(">") or not x for x in quoted) else quoted[1:]
                lines += [rng.choice(["> ", ">", "  >  "]) + x.upper() if not x.startswith(">") else ">" + x for x in quoted]
            own = [rng.choice(["Thanks", f"line {rng.randrange(50)}", f"fact {turn} {rng.random()}", "", "a > b"]) for _ in range(rng.randrange(4))]
            said[turn] = [*lines, *own]
            rows.append((conv, turn, "user", rng.choice(["\n", "\r\n"]).join(said[turn])))
    rows += [(7, 0, None, None), (7, 1, "user", ""), (None, 3, "user", "> x"), (8, None, "user", "y"), (9, 0, "user", "> only a quote"), (9, 1, "user", "end > with\n>")]
    messages = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    found = quotes.conversations(messages).collect()
    assert len(found) == len(rows)
    expected = plain(rows)
    for r in found:
        assert (r.reply_to, r.thread, r.depth, r.position, r.n_quoted) == expected[r.conv_id, r.turn], r
        assert not any(PREFIX.match(x) for x in r.text.split("\n"))
    assert any(r.depth > 1 for r in found)
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    with duckdb.connect() as con:
        con.register("conversations", table)
        assert sorted(map(str, con.execute(OP6_SQL).fetchall())) == sorted(str(tuple(r)) for r in found)
    assert quotes.conversations(messages.limit(0)).count() == 0


def test_text_and_levels(spark):
    rows = [
        (1, 0, "a", "The plan is this.\nWe meet at noon."),
        (1, 1, "b", "> The plan   is THIS.\n\nNo.\n"),
        (1, 2, "a", "On 3 May b wrote:\n>> the plan is this.\n> No.\nWhy not?"),
        (1, 3, "c", "Le 3 mai, b a écrit :\n> nothing known\n>> we meet at noon.\nOn Tuesday she wrote:\nand no quote"),
    ]
    found = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [found[k].reply_to for k in range(4)] == [None, 0, 1, 0]
    assert [found[k].thread for k in range(4)] == [0, 0, 0, 0] and found[2].depth == 2
    assert [found[k].text for k in range(1, 4)] == ["No.", "Why not?", "On Tuesday she wrote:\nand no quote"]
    assert found[2].n_quoted == 2


def replies(spark, texts):
    rows = [(1, k, "a", t) for k, t in enumerate(texts)]
    found = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    return [r.reply_to for r in sorted(found, key=lambda r: r.turn)]


def test_passages(spark):
    long = "The first thing to say is that the plan of last week will not do and that we need another one."
    assert replies(spark, [long, "other", "\n".join(f"> {x}" for x in textwrap.wrap(long, 30)) + "\nYes."]) == [None, None, 0]  # wrapped anew
    again = "one\ntwo\nthree"
    assert replies(spark, ["x", again, "y", again + "\nfour", "> one\n> two\n> three\n> four\nNo.", "> two\n> three\nWhy?"]) == [None, None, None, None, 3, 3]
    assert replies(spark, ["a b", "a b", "> a b\nc", "> a b\n> z"]) == [None, None, 1, 1]  # the latest earlier one, and lines where no passage is found
    assert replies(spark, ["p\n\nq", "r", "> r\n>> p\n>>\n>> q", ">> p\n> unknown"]) == [None, None, 1, 0]
    words = " ".join(f"w{k}" for k in range(60_000))
    assert replies(spark, [words, "> " + words.replace(" ", "\n> "), None, ""]) == [None, 0, None, None]
