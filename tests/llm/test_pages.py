import random

from promptscreen.llm import pages as P

KIND = "page_id long, url string, html string"


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_are_a_longest_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(6) for _ in range(rng.randrange(14))]
        b = [rng.randrange(6) for _ in range(rng.randrange(14))]
        got = sorted(P.common_lines(a, b))
        assert len(got) == lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_blocks():
    page = ("<html><head><title>T</title><style>p{}</style></head><body><div class='top-nav'>menu</div><header>H</header><article class=post>"
            "<h1>A &amp; B</h1><p>one<br>two <b>three</b><p>four &eacute; &#8364;\n\t five</p><script>var x='</p>'</script><aside>side</aside>"
            "<div id=comments>reader</div><!-- no --><form>f</form></article><p>loose</p><div hidden>h</div><footer>F</footer>")
    assert P.blocks(page) == [(P.CHROME, "menu"), (P.CHROME, "H"), (P.BODY, "A & B"), (P.BODY, "one two three"), (P.BODY, "four é € five"),
                              (P.CHROME, "side"), (P.CHROME, "reader"), (P.CHROME, "f"), (P.OPEN, "loose"), (P.CHROME, "h"), (P.CHROME, "F")]
    assert P.blocks(None) == [] and P.blocks("") == [] and P.blocks("a < b & c") == [(P.OPEN, "a < b & c")]
    assert len(P.blocks("<p>x" * 20_000)) == 20_000


def test_shared_lines_go_and_articles_stay(spark):
    def page(i, body):
        return f"<div>Welcome to the site</div><div>{body}</div><div>All rights reserved by us</div><div>Unlike {i}</div>"

    long = "a long article sentence that only this page has, number "
    rows = [(i, f"http://h.example/a/{i:03d}?q={i}", page(i, long + str(i) * 40)) for i in range(30)]
    rows += [(100, "http://alone.example/x", page(100, long)), (101, None, None), (102, "http://[bad", ""), (103, "http://h.example/a/005", None),
             (7, rows[7][1], rows[7][2]), (None, "http://art.example/1", "<article><p>same</p></article>"),
             (105, "http://art.example/2", "<article><p>same</p></article>")]
    got = P.main_text(spark.createDataFrame(rows, KIND).repartition(4)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for i in set(range(30)):
        assert all(t == f"{long}{str(i) * 40}\n\nUnlike {i}" for t in by[i])
    assert len(by[7]) == 2 and by[100][0].startswith("Welcome") and by[101] == by[102] == by[103] == [""]
    assert by[None] == by[105] == ["same"]
    assert P.main_text(spark.createDataFrame([], KIND)).count() == 0


def test_neighbours_are_the_sorted_order(spark):
    rng = random.Random(4)
    places = sorted({(f"h{rng.randrange(3)}", f"/p{rng.randrange(900)}", f"k{i}") for i in range(700)})
    shuffled = places[:]
    rng.shuffle(shuffled)
    got = {r["key"]: (r["before"], r["after"]) for r in P.neighbours(spark.createDataFrame(shuffled, "host string, path string, key string")).collect()}
    for i, (host, _, key) in enumerate(places):
        before = places[i - 1][2] if i and places[i - 1][0] == host else None
        after = places[i + 1][2] if i + 1 < len(places) and places[i + 1][0] == host else None
        assert got[key] == (before, after)


def test_short_articles_under_long_templates_and_runs_of_copies(spark):
    top, end = "Menu of the site with many entries " * 8, "All rights reserved, notices and further small print " * 8

    def page(*lines):
        return "".join(f"<div>{x}</div>" for x in (top, *lines, end))

    text = {i: f"short piece {i}, its own" for i in range(20)}
    rows = [(i, f"http://h.example/a/{i:03d}", page(t)) for i, t in text.items()]
    same = "an article shown under several addresses"
    rows += [(100 + i, f"http://h.example/a/010b?v={i}", page(same) + f"<footer>{i}</footer>") for i in range(4)]     # equal open text
    near = "a longer article sentence that its printed versions repeat " * 6
    rows += [(200 + i, f"http://h.example/a/014b?v={i}", page(near, f"seen {i}")) for i in range(5)]                    # near copies
    got = {r["page_id"]: r["text"] for r in P.main_text(spark.createDataFrame(rows, KIND).repartition(4)).collect()}
    assert all(got[i] == t for i, t in text.items())
    assert all(got[100 + i] == same for i in range(4))
    assert all(got[200 + i] == f"{near.strip()}\n\nseen {i}" for i in range(5))


def test_a_page_inside_another_keeps_its_text(spark):
    rows = [(1, "http://h.example/1", "<p>a story</p><p>told twice</p>"), (2, "http://h.example/2", "<p>a story</p><p>told twice</p><p>ps</p>")]
    got = {r["page_id"]: r["text"] for r in P.main_text(spark.createDataFrame(rows, KIND)).collect()}
    assert got[1] == "a story\n\ntold twice" and got[2] == "a story\n\ntold twice\n\nps"
