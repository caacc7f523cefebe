"""Copies found by windows against alignment of whole texts, and lexing by expressions against the scanner."""

import random

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import texts
from millrace.session import written


def test_windows_hold_every_copy(spark):
    rnd = random.Random(8)
    common, rare = list("abcdefgh"), [f"r{i}" for i in range(200)]
    word = lambda: rnd.choice(common) if rnd.random() < 0.7 else rnd.choice(rare)
    patterns = [(i, [rnd.choice(["$L", "$P"]) if i % 3 == 0 and rnd.random() < 0.15 else word() for _ in range(rnd.randint(1, 25))]) for i in range(40)] + [(90, []), (91, ["$L"]), (92, ["a", "a", "a", "a", "a"])]
    stories = []
    for j in range(60):
        story = [word() for _ in range(rnd.randint(0, 120))]
        for i in rnd.sample(range(40), 2):
            copy = []
            for w in patterns[i][1]:
                x = rnd.random()
                copy += [word()] if w == "$L" else ["(", word(), ")"] if w == "$P" else [] if x < 0.05 else [word()] if x < 0.1 else [w, word()] if x < 0.2 else [w]
            at = rnd.randint(0, len(story))
            story[at:at] = copy
        stories.append((j, story))
    stories += [(70, None), (71, [])]
    p = spark.createDataFrame([(i, w, [x for x in w if x[0] != "$"]) for i, w in patterns], "i long, w array<string>, told array<string>")
    t = spark.createDataFrame(stories, "j long, w array<string>")
    want = set()
    for i, w in patterns:
        plain = [x for x in w if x[0] != "$"]
        if len(plain) <= int(0.2 * len(w) + 1e-9):
            continue
        for j, s in stories:
            similarity = text.align(w, s or [])[3]
            if similarity >= 0.8 and sum(x in (s or []) for x in plain) >= 0.9 * len(plain) - 1e-9:
                want.add((i, j, round(similarity, 6)))
    got = {(r["i"], r["j"], round(r["similarity"], 6)) for r in texts.near_copies(p, t, "i", "j", "w", "told", 0.8, 0.9, written).collect()}
    assert got == want and len({i for i, _, _ in want}) > 30


def test_expressions_lex_as_the_scanner_does(spark):
    rnd = random.Random(2)
    bits = ['"', "'", "\\", "\n", "//", "/*", "*/", "#", " ", "\t", "x1", "é", "_a", "0x1Fu", "3.5e-2f", ".5", "1.", "<<=", "->", "...", "::", "@", "`", "++", "=", "(", "]", "日本", "9z"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))) for i in range(400)] + [(1000, None), (1001, '"' + "a\\n" * 20_000 + '"'), (1002, "/*" + "x*" * 50_000)]
    found = {}
    for r in texts.token_table(spark.createDataFrame(rows, "k long, s string"), "k", "s").orderBy("k", "pos").collect():
        found.setdefault(r["k"], []).append((r["pos"], r["kind"], r["token"], r["line"]))
    for k, s in rows:
        assert found.get(k, []) == [(i, *x) for i, x in enumerate(text.scan(s))], s


def test_normal_forms_cut_receivers_whole():
    cases = {
        "a ( b [ c ] ) . d -> e ( f )": "e ( f )", "x = this -> p -> q [ 1 ] . r ;": "x = r ;", "( a + b ) . c": "c", "return ( this -> a ) ; b ;": "( a ) b ;", "if ( a . b ) c -> d = 0x1Ful + 2.50f + 1.0 ;": "if ( b ) d = 0x1F + 2.50 + 1 ;",
        "sizeof ( x ) . y": "sizeof y", "this -> a ( this -> b . c , 3. )": "a ( c , 3 )", ") . x": "x", "a . b . c . d": "d", "$ . 5": "$ 5", "": "",
    }
    for source, want in cases.items():
        assert " ".join(text.normal_tokens(source.split(), set(), set())) == want, source
    assert F is not None


def test_normal_forms_make_no_names_that_nobody_asks_for(spark):
    from millrace.operators import texts

    df = spark.createDataFrame([(1, "f(a, b); // x\nreturn 1.0f;"), (2, None)], "id long, text string").selectExpr("id", "text", "array('a') AS p", "array('b') AS n")
    made = texts.normal_forms(df, "id", "text", "p", "n", informative=False)
    assert made.columns == ["id", "normal"]
    assert {r["id"]: list(r["normal"]) for r in made.collect()} == {r["id"]: list(r["normal"]) for r in texts.normal_forms(df, "id", "text", "p", "n").collect()}
