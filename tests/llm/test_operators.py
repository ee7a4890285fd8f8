import html
import math
import random
import re

from driftlog.llm import html_text, pii, secrets, toxicity
from driftlog.llm.mixture import apply_mix, mix
from driftlog.llm.toxicity import FuzzyTrie, Model, Scorer, learn, with_scores

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((x * 2 - 9 if x * 2 > 9 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def test_base_spans_against_plain_patterns(spark):
    odd = ["a@b.c%d@e.f x.y@z 1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1", "4111 1111 1111 1111-4111111111111111 5", "é😀 4111111111111111 😀 a@b.co", "1" * 9000, None, "", "+" * 50 + "1" * 20, "a." * 5000 + "@b.c.", "1.2.3.004 0001.2.3.4"]
    got = {r.doc_id: r.base for r in pii.pii_spans(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()}
    for i, t in enumerate(odd):
        want = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if valid(k, m[0]))
        assert [(s.start, s.n, s.kind, s.end) for s in got[i]] == want
    rows = [(i, f"Contact Zebra{i % 40} user{i}@mail.example.com now") for i in range(40)] + [(i, f"plain words {i}") for i in range(40, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in clean[3] and "Contact" not in clean[3] and clean[99] == "plain words 99"


def test_terms_that_reveal_one_entity(spark):
    """A name beside its address in several surroundings goes; what stands around copies of one passage stays."""
    word = lambda i, k: f"w{i * 37 % 1000}x{k}"
    rows = [(i, f"{word(i, 1)} {word(i, 2)} Zorvath one@mail.example.com {word(i, 3)} {word(i, 4)}") for i in range(5)]
    rows += [(i, f"{word(i, 1)} some copied rare passage two@mail.example.com stays just so {word(i, 2)}") for i in range(10, 20)]
    rows += [(i, f"{word(i, 1)} {word(i, 2)} only{i % 2} {i}@mail.example.com {word(i, 3)} {word(i, 4)}") for i in range(20, 26)]
    rows += [(i, f"plain Zebra words {i}") for i in range(100, 500)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Zorvath" not in clean[i] and "[EMAIL]" in clean[i] and word(i, 2) in clean[i] for i in range(5))
    assert all(clean[i] == t.replace("two@mail.example.com", "[EMAIL]") for i, t in rows[5:15])
    assert all(f"only{i % 2}" in clean[i] for i in range(20, 26)) and clean[100] == "plain Zebra words 100"


def test_names_with_function_words_beside_them(spark):
    """Four of six places repeat, the surroundings don't: the names go, words that are common elsewhere stay."""
    rows = [(i, f"v{i}a v{i}b Maria Lopez at x@y.example.com for v{i}c v{i}d v{i}e") for i in range(6)]
    rows += [(i, f"plain words at home for all {i}") for i in range(100, 500)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Maria" not in clean[i] and "Lopez" not in clean[i] and " at " in clean[i] and " for " in clean[i] and f"v{i}b" in clean[i] for i in range(6))


def test_terms_become_their_class_where_that_is_harmless(spark):
    rows = [(i, f"v{i}a v{i}b Zorvath one@mail.example.com v{i}c v{i}d Quixel") for i in range(6)]
    rows += [(i, f"zornig zorbas zorro words {i}") for i in range(100, 400)]  # many words begin as the first name does, none as the other
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(clean[i] == f"v{i}a v{i}b zor* [EMAIL] v{i}c v{i}d " for i in range(6))


def plain_disclosure(texts, support, alpha):
    """(kind, value or None, term) by the definitions alone, for texts whose only entities are addresses."""
    mail, term, n = re.compile(BASE["email"]), re.compile(r"[^\W_]+"), len(texts)
    held, near, outside, every = {}, [], {}, {}
    for row, t in enumerate(texts):
        every[row] = {w.lower() for w in term.findall(t)}
        found = list(mail.finditer(t))
        if not found:
            continue
        held[row] = {m[0] for m in found}
        outside[row] = {w.lower() for w in term.findall(mail.sub(" ", t))}
        cuts = [0, *(x for m in found for x in m.span()), len(t)]
        for k, m in enumerate(found):
            before, after = t[cuts[2 * k] : m.start()][-60:], t[m.end() : cuts[2 * k + 3]][:60]
            before = re.sub(r"^[^\W_]+", "", before) if len(before) == 60 else before
            after = re.sub(r"[^\W_]+$", "", after) if len(after) == 60 else after
            sides = [w.lower() for w in term.findall(before)][-3:], [w.lower() for w in term.findall(after)][:3]
            near.append((row, m[0], (tuple(sides[0]), tuple(sides[1])), {*sides[0], *sides[1]}))
    df = {}
    for words in every.values():
        for w in words:
            df[w] = df.get(w, 0) + 1
    of = {v: sum(v in x for x in held.values()) for x in held.values() for v in x}
    told = set()

    def ask(value, w, docs, of, sure):
        p, z = docs / df[w], sure * sure / df[w]
        low = (p + z / 2 - math.sqrt(max(z * (p * (1 - p) + z / 4), 0))) / (1 + z)
        if of < n and math.log2(low * n / of) >= -alpha * math.log2(of / n):
            told.add((value, w))

    for w in {w for *_, ws in near for w in ws}:
        mine = [(r, v, c) for r, v, c, ws in near if w in ws]
        if len({v for _, v, _ in mine}) >= support:
            ask(None, w, len({r for r, *_ in mine}), len(held), 0)
    for v in of:
        if of[v] < 3:
            continue
        own = [(r, c, ws) for r, x, c, ws in near if x == v]
        for w in {w for *_, ws in own for w in ws}:
            mine = [(r, c) for r, c, ws in own if w in ws]
            docs = len({r for r, _ in mine})
            if docs >= max(3, of[v] / 2) and len({c for _, c in mine}) >= 3:
                ask(v, w, docs, of[v], 0)
        for w in {w for r, *_ in own for w in outside[r]}:
            mine = [(r, c) for r, c, _ in own if w in outside[r]]
            docs = len({r for r, _ in mine})
            if docs >= max(3, of[v] / 2) and len({c for _, c in mine}) >= 3:
                ask(v, w, docs, of[v], 0)
    for w in {w for ws in outside.values() for w in ws}:
        rows = [r for r in outside if w in outside[r]]
        if len({frozenset(held[r]) for r in rows}) >= support:
            ask(None, w, len(rows), len(held), 4.0)
    return [{w for v, w in told if row in held and (v is None or v in held[row]) and w in outside[row]} for row in range(n)]


def test_disclosure_against_a_plain_version(spark):
    rng = random.Random(8)
    names = {f"p{k}@mail{k % 3}.example.com": f"Name{k}x" for k in range(12)}
    texts = []
    for i in range(500):
        words = [f"w{rng.randrange(120)}" for _ in range(rng.randrange(1, 30))]
        if i % 4 == 0:
            v = rng.choice(list(names))
            words.insert(rng.randrange(len(words) + 1), rng.choice([f"contact {v}", f"{names[v]} {v}", v, f"mail: <{v}>"]))
            words.insert(rng.randrange(len(words) + 1), rng.choice([names[v], "Contact", "w5"]))
        texts.append(rng.choice([" ", ", "]).join(words))
    got = {r.doc_id: (r.spans, r.base) for r in pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), support=5).collect()}
    want, total = plain_disclosure(texts, 5, pii.ALPHA), 0
    for i, t in enumerate(texts):
        spans, base = got[i]
        added = [t[s.start : s.end] for s in spans if s.kind == "term"]
        hidden = "".join(" " if any(b.start <= k < b.end for b in base) else c for k, c in enumerate(t))
        assert sorted(added) == sorted(m[0] for m in re.finditer(r"[^\W_]+", hidden) if m[0].lower() in want[i])
        total += len(added)
    assert total > 50


def test_very_many_matches_in_one_text(spark):
    import time

    text = "a@b.co é " * 100_000
    began = time.time()
    (row,) = pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.text == "[EMAIL] é " * 100_000 and time.time() - began < 120


def test_terms_far_from_their_entity(spark):
    """A name in the heading goes wherever it stands in the entity's documents, as does a heading that goes with a kind."""
    pad = lambda i, n: " ".join(f"f{(i * 31 + k * 7) % 150}" for k in range(n))
    rows = [(i, f"Zorvath heads this {pad(i, 12)} u{i}a to one@mail.example.com of u{i}b {pad(i + 9, 9)} (Zorvath), end") for i in range(5)]
    rows += [(i, f"Dossier {pad(i, 14)} user{i}@mail.example.com {pad(i + 3, 14)} signed DOSSIER") for i in range(20, 50)]
    rows += [(i, f"plain end signed heads this to of {pad(i, 30)}") for i in range(100, 500)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Zorvath" not in clean[i] and "[EMAIL]" in clean[i] and f"u{i}b" in clean[i] and clean[i].endswith("(), end") for i in range(5))
    assert all("dossier" not in clean[i].lower() and clean[i].endswith("signed ") for i in range(20, 50))
    assert all(clean[i] == t for i, t in rows if i >= 100)


def scan(spark, texts):
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in rows}


def test_weak_credentials_need_a_partner(spark):
    loose = ["Zx9Kq2Lm8Vb4Nc7Tr1Wp", "JBSWY3DPEHPK3PXPQ7RT2VLM", "zx9kq2lm8vb4nc7tr1wp"]
    texts = [f"a {x} b" for x in loose] + [f"client_id = abc123 {x}" for x in loose] + [f"client_id = abc123\n\n{loose[0]}", f"client_id = abc123 {'w ' * 160} {loose[0]}", 'token = "abcdef" AKIA' + "A" * 16]
    got = scan(spark, texts)
    assert not any(got[i] for i in (0, 1, 2, 6, 7))
    assert all([k for k, *_ in got[i]] == ["ident", "secret"] and got[i][1][1:3] == (19, 19 + len(loose[i - 3])) for i in (3, 4, 5))
    assert got[8] == [("assign", 0, 15, True), ("access", 17, 37, True)]


PLAIN = {
    "assign": (r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:w|W)(?:o|O)(?:r|R)(?:d|D)|(?i:passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def test_secrets_against_plain_patterns_and_all_pairs(spark, monkeypatch):
    """The base as the contract's patterns give it; links as comparing each weak part with every other part gives them."""
    rng = random.Random(11)
    words = ["password=", "Token: ", "api_key='", "hunter22x", "AKIA" + "B7" * 9, "c0ffee" * 4, "c0ffee" * 3, "user = bob1", "login:al.ice", "https://api.example.com/v1", "host=db1.example.net:99", "Zx9Kq2Lm8Vb4Nc7Tr1Wp", "q7RT2VLMJBSWY3DPEHPK", "plain", "words", "é😀", "\n", "\n \n", "SECRET" , "= ", "x" * 300]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randrange(40))) for _ in range(400)]
    monkeypatch.setattr(secrets, "CELL", 64)
    got = scan(spark, texts)
    more = 0
    for i, text in enumerate(texts):
        base = sorted((m.start(), n, k, m.end()) for n, (k, (p, ok)) in enumerate(PLAIN.items()) for m in re.finditer(p, text, re.A) if ok(m))
        assert [(s, k, e) for s, _, k, e in base] == [(s, k, e) for k, s, e, b in got[i] if b]
        free = lambda m: all(e <= m.start() or s >= m.end() for s, _, _, e in base)
        ends = [m.span() for m in secrets.ENDPOINT.finditer(text) if free(m)]
        left = [("ident", *m.span()) for m in secrets.IDENT.finditer(text) if free(m)] + [("endpoint", *x) for x in ends]
        keys = [("secret", *m.span()) for m in secrets.LOOSE.finditer(text) if free(m) and not any(s <= m.start() < e for s, e in ends) and secrets._looks_random(m[0])]
        sides = [left + [(k, s, e) for s, _, k, e in base if k == "access"], keys + [(k, s, e) for s, _, k, e in base if k != "access"]]

        def near(a, b):
            lo, hi = (a, b) if a[2] <= b[1] else (b, a)
            return lo[2] <= hi[1] <= lo[2] + secrets.REACH and not re.search(r"\n[ \t]*\n", text[lo[1] : hi[1] + 1])

        want = {x for x in left if any(near(x, y) for y in sides[1])} | {x for x in keys if any(near(x, y) for y in sides[0])}
        assert want == {(k, s, e) for k, s, e, b in got[i] if not b}
        more += len(want)
    assert more > 200


def test_main_text(spark):
    page = '<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><a href="/">menu</a></nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>One  two<br><p>Three\nfour</p><div class="comments"><p>me too</p></div></article><footer>f</footer></body></html>'
    df = spark.createDataFrame([(1, "http://a.example/x", page), (2, None, None), (3, "http://a.example/y", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got == {1: "A & B\nOne two\nThree four", 2: "", 3: ""}


def text_of(page):
    return html_text.extract(page, html_text.best_path(page)[0])


def test_markup_is_read_as_browsers_read_it():
    wrap = lambda x: f"<body><article>{x}</article></body>"
    assert text_of(wrap("<p>" + "\u0130" * 20 + "<script>x</script></p><p>kept</p>")) == "\u0130" * 20 + "\nkept"
    assert text_of(wrap('<p class="a"">Hello<p title=it\'s>you <b data-x=">">all</b>')) == "Hello\nyou all"
    assert text_of(wrap("<p>1 < 2 <3 &lt;b&gt; a<!-- > x --> b</p>")) == "1 < 2 <3 <b> a b"
    assert text_of(wrap("<p>x <SCRIPT>a</scripty></ScRiPt >y</p><p>z</p><p")) == "x y\nz"
    assert text_of(wrap("<p>a &am" + "<b>p; b</b></p>")) == "a &amp; b"
    deep = "<div>" * 30_000 + "<b>" * 30_000 + "deep" + "</i>" * 30_000
    assert text_of(f"<body>{deep}") == "deep"


def test_words_in_names_are_no_verdict():
    page = """<body><header>Site</header><article><div class="entry-header"><h1>Head</h1></div><section class="social-policy"><p>On policy.</p></section>
      <blockquote class="notice-board">Quote</blockquote><p>x<math><mi>y</mi></math></p><div class="social-tools"><a href="/">Tweet it now</a> or</div>
      <div id="reader-comments"><p>me too, a long remark that says much</p></div><div class="ad-slot">Buy</div></article></body>"""
    assert text_of(page) == "Head\nOn policy.\nQuote\nxy"


def test_the_host_decides(spark):
    """A page whose longest container is not the one that its host's articles stand in."""
    page = lambda body, more: f'<body><div class="story">{body}</div><div class="teasers">{more}</div></body>'
    long, short = "<p>" + "An article of many words. " * 9 + "</p>", "<p>A short one.</p>"
    rows = [(i, "http://a.example/", page(long, "<p>more</p>")) for i in range(5)] + [(9, "http://a.example/9", page(short, long)), (10, "http://b.example/", page(short, long))]
    got = {r.page_id: (r.text, r.consensus) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == ("A short one.", True) and got[10][0].startswith("An article") and got[0][0].startswith("An article")


def test_main_text_of_generated_pages(spark):
    """Pages built from a list of blocks: the article's blocks come back, whatever stands around them."""
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["río", "a", "word", "x&y", "<tag>", "naïve", "1", "“so”"]) for _ in range(n))
    rows, want = [], {}
    for i in range(120):
        blocks = [words(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 9))]
        coded = [rng.choice(["<p>{}</p>", "<p>{}", "<div class='c1'>{}</div>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<p><b>{}</b></p>"]).format(html.escape(b).replace(" ", rng.choice([" ", "\n", "  ", " <i></i>"]))) for b in blocks]
        noise = [f"<nav><a href=/>{words(60)}</a></nav>", f'<div class="ad">{words(9)}</div>', f"<footer>{words(30)}</footer>", f"<aside>{words(30)}</aside>", f"<form>{words(5)}</form>", "<script>if (a<b) '</p>'</script>", f'<section id="comments">{words(30)}</section>', f"<!-- {words(5)} -->"]
        rng.shuffle(noise)
        inner = [x for pair in zip(coded, rng.choices(noise[:4] + [""] * 9, k=len(coded))) for x in pair]
        rows.append((i, f"https://h{i % 7}.example/{i}", f"<html><head><title>t</title></head><body>{noise[4]}<article>{''.join(inner)}</article>{noise[5]}{noise[6]}</body></html>"))
        want[i] = "\n".join(blocks)
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 17), s) for i, s in enumerate(["a", "b", None, "c"] * 30)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source, total = {i: s for i, _, s in rows}, sum(r.size for r in got)
    for s in ("a", "b", "c", None):
        own = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and all(r.taken <= 3 * r.size for r in own)
    assert abs(sum({source[r.doc_id]: r.target for r in got}.values()) - total) < 1e-6
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_texts_that_share_an_id_have_their_own_passes(spark):
    rows = [(1, "", "a"), (1, "one two three", "a"), (2, "four five", "a"), (2, None, "a")]
    got = sorted(r.text or "" for r in apply_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got == ["four five", "one two three"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_against_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 300)
    rng = random.Random(6)
    word = lambda lo, hi: "".join(rng.choice("abcé") for _ in range(rng.randrange(lo, hi)))
    terms = {word(5, 16) for _ in range(60)}
    trie = FuzzyTrie(terms)
    found = 0
    for _ in range(4000):
        w = list(rng.choice(sorted(terms)) if rng.random() < 0.8 else word(3, 18))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = word(0, 2)
        w = "".join(w)
        want = min(((d, t) for t in terms if (d := distance(w, t)) <= toxicity.edits(t)), default=None)
        assert trie.nearest(w) == want
        found += want is not None and want[0] > 0
    assert found > 500


def test_context_decides(spark, monkeypatch):
    """Harmless documents quote what toxic ones say: the same words score above the threshold in abuse, below it in quotation."""
    toxic = [(i, f"note{i} you vilest scum{i} of all{i * 7}", 1) for i in range(60)]
    quote = [(i, f'note{i} she said "you vilest scum{i} of all{i * 7}" then', 0) for i in range(60, 90)]
    rows = toxic + quote + [(i, f"note{i} a fine day{i % 9}", 0) for i in range(90, 600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = learn(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    abuse, told = "note you vilest scum of all", 'note she said "you vilest scum of all" then'
    assert Scorer(model).score(abuse) >= toxicity.THRESHOLD > Scorer(model).score(told)
    monkeypatch.setattr(toxicity, "QUOTED", 1.0)
    monkeypatch.setattr(toxicity, "REPORTED", 1.0)
    assert Scorer(model).score(told) >= toxicity.THRESHOLD


def test_automata_and_context(spark):
    trie = FuzzyTrie(["moron", "pathetic"])
    assert [(trie.nearest(w) or (0, None))[1] for w in ("moron", "morom", "moon", "morron", "mrn", "pathetik")] == ["moron", "moron", "moron", "moron", None, "pathetic"]
    scorer = Scorer(Model({"moron": 5.0}, {}, frozenset(), -4.0, (1.0, 1.0)))
    assert scorer.score("you moron") > scorer.score('he said "moron" then') > scorer.score("fine") == scorer.score("")
    rows = [(i, f"word{i} " + (f"you{i} vilest thing{i}" if i % 4 == 0 else "fine day")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = learn(docs, labels)
    assert "vilest" in model.terms
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in with_scores(docs, model).collect())
    assert learn(docs, labels.filter("toxic = 0")).terms == {}
