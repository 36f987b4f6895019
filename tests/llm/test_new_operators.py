"""Operators 11 to 13: conversation repair, HTML extraction, fill-in-middle."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from almanac.llm import conversations as conv
from almanac.llm import html_text, infill
from almanac.llm import queries as Q

SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- 11: conversations

def cheapest(rows: list[tuple[str, str, str]]) -> tuple[int, str, str]:
    """(cost, audit, text) over all edit sequences with up to two insertions between rows; rows: role, text, fault."""
    best = None
    def walk(i, cost, audit, turns):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows):
            for k in range(3):
                for extra in itertools.product(("user", "assistant"), repeat=k):
                    out = turns + [(r, "") for r in extra]
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                        found = (cost + 5 * k, audit + "I" * k, "\n".join(f"{r}:{t}" for r, t in out))
                        best = found if best is None else min(best, found)
            return
        role, text, fault = rows[i]
        for k in range(3):
            for extra in itertools.product(("user", "assistant"), repeat=k):
                before = turns + [(r, "") for r in extra]
                walk(i + 1, cost + 5 * k + 2, audit + "I" * k + "D", before)
                if fault not in ("blank", "duplicate"):
                    late = 5 * (fault == "truncated")
                    walk(i + 1, cost + 5 * k + late, audit + "I" * k + "K", before + [(role, text)])
                    for r in ("user", "assistant"):
                        walk(i + 1, cost + 5 * k + late + 1, audit + "I" * k + "R", before + [(r, text)])
    walk(0, 0, "", [])
    return best


def faults(rows):
    """(role, text, fault) of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = ("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain(rows) -> tuple:
    """The report of one conversation by plain dynamic programming over whole strings; rows (turn, role, text) sorted."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    marked = faults(rows)
    initials = [r[:1] for r, _, _ in marked]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(2):
            for state, (cost, audit, out) in list(best.items()):
                role = "assistant" if state == "u" else "user"
                way = (cost + 5, audit + "I", out + ((role, ""),))
                best[role[0]] = min(way, best.get(role[0], way))
        return best

    for role, text, fault in marked:
        new = {}
        def offer(state, way):
            new[state] = min(way, new.get(state, way))
        for state, (cost, audit, out) in insert(dict(best)).items():
            offer(state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            late = 5 * (fault == "truncated")
            if role[:1] in grammar[state]:
                offer(role[0], (cost + late, audit + "K", out + ((role, text),)))
            other = "assistant" if state == "u" else "user"
            offer(other[0], (cost + late + 1, audit + "R", out + ((other, text),)))
        best = new
    cost, audit, out = min(v for k, v in insert(dict(best)).items() if k in ("", "a"))
    kinds = [f for _, _, f in marked]
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit,
            sha("\n".join(f"{r}:{t}" for r, t in out)))


def some_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", "usr", ""]
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why? ", "a.b", "Go.\n"]
    return [(i, rng.choices(roles, (6, 6, 2, 1, 1, 1))[0], rng.choices(texts, (5, 3, 2, 1, 1, 2, 1, 2))[0] + (str(i) + "." if rng.random() < .6 else ""))
            for i in range(n)]


def test_search_equals_all_edit_sequences():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4) * 12:
        marked = faults(some_rows(rng, n))
        rows = [conv.Row(i, r, t, 1, f, r[:1]) for i, (r, t, f) in enumerate(marked)]
        report = conv._whole(iter([(0, -1, False, i, *row) for i, row in enumerate(rows)]))
        cost, audit, text = cheapest(marked)
        assert report[5:] == (cost, audit, sha(text)), marked


def test_search_forgets_what_is_settled():
    rng = random.Random(5)
    search, held = conv.Search(), 0
    rows = (conv.Row(i, ("user", "assistant")[i % 2] if rng.random() < .9 else "tool", f"{i}.", 1, "" if rng.random() < .9 else "truncated", "")
            for i in range(20_000))
    emitted = 0
    for row in rows:
        row = row._replace(initial=row.role[:1])
        emitted += sum(1 for _ in search.step(row, conv.moves_of(row)))
        depth, node = 0, next(iter(search.live.values()))[2]
        while node is not search.root:
            depth, node = depth + 1, node.parent
        held = max(held, depth)
    assert held < 100 and emitted > 19_900


def repaired(spark, rows, copies=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra string, part string")
    return {r["conv_id"]: tuple(r)[1:] for r in conv.repair(df, copies).collect()}


@pytest.mark.parametrize("cut", [False, True])
def test_repair_equals_plain_programming(spark, cut):
    rng = random.Random(7 + cut)
    rows = []
    for c in range(60):
        rows += [(c, *r, "x", "y") for r in some_rows(rng, rng.randrange(1, 9))]
    rows += [(None, None, None, None, None, None), (None, 3, "user", "Hi.", None, None), (None, 3, "user", "Hi.", None, None), (77, None, "user", "", None, None)]
    if cut:  # one conversation with most rows lies in several ranges
        rows += [(1000, *r, None, None) for r in some_rows(rng, 3_000)]
        rows += [(1000, 40, "user", "Same.", None, None)] * 50
    got = repaired(spark, rows)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", (r[3] if r[3] is not None else " "))
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=key)
        want[c] = plain([(r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in own])
    assert set(got) == set(want)
    for c in want:
        assert got[c] == want[c], c


def test_cut_conversations_give_edits_in_order(spark):
    rng = random.Random(11)
    rows = [(5, *r, None, None) for r in some_rows(rng, 2_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra string, part string")
    table = conv.placed(df)
    assert table.where("cut").select("part").distinct().count() > 1
    got = conv.edits(df).orderBy("part", "seq").collect()
    want = plain([r[1:4] for r in rows])
    assert "".join(r["edit"] for r in got) == want[6]
    assert sha("\n".join(f"{r['role']}:{r['text']}" for r in got if r["edit"] != "D")) == want[7]


def test_repair_of_an_empty_table(spark):
    assert repaired(spark, []) == {}


def damage(rows):
    """conv_id -> damaged rows (turn, role, text) of the contract."""
    out = {}
    for c, turn, role, text in rows:
        at = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(c, [])
        if at == 1:
            text = ""
        if at == 2:
            text = re.sub("[.!?]", "", text)
        if at == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if at == 0 else 2 if at == 3 else 1)
    return out


def test_op11_equals_plain_programming(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in Q.QUERIES["op11_conversations"](spark, SF).collect()}
    damaged = damage(rows)
    assert set(got) == set(damaged)
    for c, own in damaged.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert got[c] == plain(own), c


def test_op11_of_conversations_without_rows_left(spark, tmp_path):
    ids = [i for i in range(400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    spark.createDataFrame([(i, 0, "user", "Hi.") for i in ids] + [(None, None, None, None)], "conv_id long, turn long, role string, text string") \
        .write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in Q.QUERIES["op11_conversations"](spark, str(tmp_path)).collect()}
    assert ids and all(got[i] == (0, 0, 0, 0, 0, 0, "", sha("")) for i in ids) and None in got


# ---------------------------------------------------------------- 12: pages

ARTICLE = ("<article><h1>A &amp; B</h1><p>First, a paragraph of some length; it goes on.<p>Sho<b>rt</b>.</p>"
           "<ul><li>one<li>two</ul><p>Third,\n a   longer paragraph<br>with a break, and an end.</p>{}</article>")
WANT = "A & B First, a paragraph of some length; it goes on. Short. one two Third, a longer paragraph with a break, and an end."


@pytest.mark.parametrize("inside", ["", "<aside>Aside, of course. Yes.</aside>", "<form><p>Write, please.</p><input><button>Go</button></form>",
                                    "<section id='comments'><p>Nice, very nice, a long comment. Really.</p></section>",
                                    "<div class='ad-box'>Buy, buy, buy now.</div>", "<!-- <p>gone.</p> --><script>var a='</p><p>no.';</script>"])
def test_article_without_what_surrounds_it(inside):
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'><header><h2>Site, of news.</h2></header>"
            "<nav><ul><li><a href='/'>Home</a></ul></nav><div class='cookie-notice'>We use cookies, do we? Yes.</div>" + ARTICLE.format(inside) +
            "<div class='sidebar'><p>Side, side. Side.</p></div><div id='comments'><p>First, a comment. Long enough, it is.</p></div><footer>&copy; x.")
    assert html_text.main_text(page) == WANT


def test_articles_without_article_elements():
    page = ("<body><div id='top'><a href=x>Home</a> <a href=y>News</a> <a href=z>Sports</a></div><div class='text'><h1>Title</h1><div>First, a paragraph of "
            "some length; it goes on. And on, again.</div><div>Short.</div><div>Another, longer one: it has more words, and marks.</div></div>"
            "<div id='bottom'>Imprint</div></body>")
    assert html_text.main_text(page) == ("Title First, a paragraph of some length; it goes on. And on, again. Short. "
                                         "Another, longer one: it has more words, and marks.")


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<nav>a</nav>", ""), ("just text, no markup &lt;x&gt;", "just text, no markup <x>"), ("<p>One, two.</p><p cla", "One, two."),
    ("<p>One, two.</p><p>b</p>", "One, two. b"), ('<p title="a>One, two.</p><p>b</p>', "One, two. b"), ("<p>a &am b &amp c&nbsp;d.", "a &am b & c d."),
    ("<div>" * 20_000 + "Deep, down." + "</div>" * 20_000, "Deep, down."), ("<script>never closed <p>a.</p>", "")])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_very_long_pages():
    page = "<article>" + "<p>Some words, in a line.</p><p>x</p>" * 50_000 + "</article><footer>end.</footer>"
    assert html_text.main_text(page) == " ".join(["Some words, in a line. x"] * 50_000)


def test_op12_on_nulls_repeats_and_empty_tables(spark, tmp_path):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", ARTICLE.format(""), "x"), (1, "u", ARTICLE.format(""), "x"), (None, None, None, None), (2, "v", "", None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/pages.parquet")
    got = sorted((tuple(r) for r in Q.QUERIES["op12_html_text"](spark, f"{tmp_path}/a").collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/pages.parquet")
    assert Q.QUERIES["op12_html_text"](spark, f"{tmp_path}/b").collect() == []


def test_op12_takes_the_whole_article_of_each_page(spark):
    import html
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.QUERIES["op12_html_text"](spark, SF).collect():
        body = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(p|h1|br)>", "\n", body))).split())


# ---------------------------------------------------------------- 13: fill-in-middle

def rearranged(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    d = sha("42:" + ("" if doc_id is None else str(doc_id)))
    h = [int(d[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), sha(out), sha(text)


ODD_TEXTS = ["", None, " ", "\t\x0b\x0c\r\n", "a", " a ", "ä ö ü 😀 \x85x", "<P> in it", "< P > <S", "a<S>b", "<", "x <", "<M", "é" * 5_000 + " ",
             "word " * 200_000]


def test_op13_equals_a_plain_version(spark, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(i, t) for i in range(10_000, 10_030) for t in ODD_TEXTS[:-1]] + [(7, ODD_TEXTS[-1]), (7, ODD_TEXTS[-1]), (None, "a b c"), (None, None)]
    spark.createDataFrame([(i, t, "z", "form") for i, t in docs], "doc_id long, text string, output string, form string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in Q.QUERIES["op13_infill"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, *rearranged(i, t)) for i, t in docs), key=str)


def test_restored_texts_are_the_originals(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    back = infill.restore(infill.transform(docs))
    assert {(r["doc_id"], r["restored"]) for r in back.collect()} == {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    assert {r["form"] for r in back.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    empty = docs.limit(0)
    assert infill.restore(infill.transform(empty)).collect() == []


def test_pieces_are_cut_and_put_back():
    whole = [infill.Piece(0, 0, 10)]
    left, right = infill.cut(whole, 4)
    assert (left, right) == ([infill.Piece(0, 0, 4)], [infill.Piece(0, 4, 10)])
    assert infill.cut(left + right, 7) == ([infill.Piece(0, 0, 4), infill.Piece(0, 4, 7)], [infill.Piece(0, 7, 10)])
    for form in infill.ORDERS:
        parts = [[infill.Piece(0, 0, 2)], [infill.Piece(0, 2, 2)], [infill.Piece(0, 2, 10)]]
        text = b"ab <<S cd "
        out = b"".join(infill.streamed(infill.arrange(parts, form), text))
        assert b"".join(infill.streamed(infill.inverse(out, form), out)) == text
