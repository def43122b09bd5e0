"""Language ID, quality rules, SimHash, HTML and the pipeline, against brute force and planted cases."""

import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidemill.llm import common, components, html, langid, quality, simhash
from tidemill.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp int, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, "clash", 1, "clash") for i, t, lang in rows], SCHEMA)


# ---- language ID


def test_languages_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = queries()["op2_langid"](spark, big)
    both = got.join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = both.count(), both.where("lang = lang_pred").count()
    assert n > 100 and right >= 0.97 * n
    assert got.where("score < 0 or score > 1").count() == 0


def plain_grams(text):
    clean = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    return {clean[i : i + n] for n in range(langid.N_MIN, langid.N_MAX + 1) for i in range(len(clean) - n + 1)}


def sample_texts(spark, sf_dir, n):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and length(text) between 20 and 20000").orderBy("doc_id").limit(n).collect()
    return [r.text for r in rows], [r.lang for r in rows]


def test_kernel_is_the_plain_one(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 50)
    texts = ["Ab, ab! c", "xyz", "ab  c\nq", "Ωa ωA 日本語 x1y", *sample_texts(spark, sf_dir, 30)[0]]
    keys, plain = [langid.grams(t) for t in texts], [plain_grams(t) for t in texts]
    for a, b in zip(keys, plain):
        assert len(a) == len(b) and all(x < y for x, y in zip(a[:-1], a[1:]))
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(keys[i], keys[j])) == len(plain[i] & plain[j])


def test_ridge_against_brute_force(spark, sf_dir, monkeypatch):
    """The model's scores are those of a ridge regression written out with Python sets and one normal equation a language."""
    texts, langs = sample_texts(spark, sf_dir, 120)
    new = sample_texts(spark, sf_dir, 160)[0][120:]
    monkeypatch.setattr(langid, "LANDMARKS", 5)
    model = langid.fit_texts(texts, langs)
    languages = sorted(set(langs))
    assert model.languages == languages and len(languages) > 2
    marks = [t for x in languages for t in [t for t, y in zip(texts, langs) if y == x][:5]]
    sets = {t: plain_grams(t) for t in [*texts, *new]}
    kernel = lambda a, b: len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5
    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k)
    feature = lambda t: np.append(np.array([kernel(t, m) for m in marks]) @ vectors / np.sqrt(values), 1.0)
    x = np.array([feature(t) for t in texts])
    share = np.diag([1 / langs.count(y) for y in langs])
    f = []
    for language in languages:
        target = np.array([1.0 if y == language else -1.0 for y in langs])
        w = np.linalg.solve(x.T @ share @ x + langid.RIDGE * np.eye(x.shape[1]), x.T @ share @ target)
        f.append([feature(t) @ w for t in new])
    f = np.array(f).T
    labels, scores = model.decide(new)
    assert labels == [languages[i] for i in f.argmax(axis=1)]
    assert np.allclose(scores, np.clip((f.max(axis=1) + 1) / 2, 0, 1), atol=1e-6)


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than landmarks and sample, and one whose texts all are long."""
    monkeypatch.setattr(langid, "TOTAL_SAMPLE", 10)
    monkeypatch.setattr(langid, "TOTAL_LANDMARKS", 12)
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 500)
    alphabet = [chr(0x4E00 + i) for i in range(400)]
    word = lambda k, j: "".join(alphabet[(k * 20 + j * 7 + i) % 20 + k * 20] for i in range(4))
    rows = [(100 * k + j, " ".join(word(k, j + i) for i in range(8 if k else 300)), f"l{k:02}") for k in range(20) for j in range(3)]
    model = langid.fit(docs(spark, rows))
    assert model.languages == [f"l{k:02}" for k in range(20)]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs(spark, rows), model, keep=["doc_id"]).collect()}
    own = set(range(0, 20))
    right = {k for k in own if all(got[100 * k + j] == f"l{k:02}" for j in range(3))}
    assert len(right) >= 12  # those with a landmark; scripts here share nothing


def test_language_edges(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund lag auf dem bett", "de"), (3, None, "en"), (4, "", "de"), (5, "123 !!", "en"), (6, "the dog and the cat", None), (6, "the dog and the cat", None), (None, "der die das", "de")]
    df = docs(spark, rows)
    model = langid.fit(df)
    assert model.languages == ["de", "en"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(df, model, keep=["doc_id"]).collect()]
    assert [(i, x) for i, x, _ in got] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en"), (None, "de")]
    assert got[5] == got[6] and got[2][2] == 0
    assert langid.predict(docs(spark, []), model).count() == 0
    nothing = langid.fit(docs(spark, [(1, "a", None)]))
    assert langid.predict(df, nothing).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_of_many_copies_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 4)
    rare = [(i, f"der hund lag auf dem bett nummer {'abcdefghij'[i]}", "de") for i in range(10)]
    rows = rare + [(100 + i, "das ist immer der gleiche satz", "de") for i in range(4000)] + [(9000 + i, f"the cat sat on mat {'abcdefghij'[i]}", "en") for i in range(10)]
    seen = []
    monkeypatch.setattr(langid, "fit_texts", lambda texts, langs: seen.append((texts, langs)))
    langid.fit(docs(spark, rows))
    texts, langs = seen[0]
    assert langs == ["de"] * 4 + ["en"] * 4 and len(set(texts)) == 8


# ---- quality

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


CLEAN = "The first sentence of this text is plain. The second one goes on for a while, as sentences do.\nThen a new line begins, and it ends with a full stop too.\nSo does this."
MENU = "Home | News | Sport | Contact | About\nLogin | Register | Help | More"
TEXTS = [None, "", " \t\n\x0b\x0c\r ", CLEAN, CLEAN + "\n" + MENU, MENU * 5, "a b c d e f g h " * 40, CLEAN.replace(" ", " "), "Buy!! NOW!! " * 30, "x%%% y### z&&& " * 20, CLEAN + "\n" + CLEAN, "é" * 10 + " 🙂 <b> " + CLEAN, "one two three\none two three\n\n one two three"]


def test_quality_counts(spark):
    df = docs(spark, [(i, t, None) for i, t in enumerate(TEXTS)] + [(3, CLEAN, None), (None, CLEAN, None)])
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.judge(docs(spark, [])).count() == 0
    assert got[None].kept and got[3].kept and got[3].cleaned == CLEAN
    assert got[4].kept and got[4].cleaned == CLEAN  # the menu's lines go, the document stays
    assert not any(got[i].kept for i in (0, 1, 2, 5, 6, 8, 9))
    assert got[0].cleaned is None


# Sentences of several scripts, with their own end marks only.
SCRIPTS = {
    "hi": "सुबह की रेलगाड़ी आज फिर देर से आई और सब लोग बात करते रहे।",
    "ar": "هل وصل القطار في موعده اليوم أم تأخر مرة أخرى كما في الأمس؟",
    "ur": "صبح کی گاڑی آج پھر دیر سے آئی اور سب لوگ باتیں کرتے رہے۔",
    "am": "ጠዋት ባቡሩ ዛሬ እንደገና ዘግይቶ መጣ እና ሁሉም ሰዎች ተነጋገሩ።",
    "my": "မနက် ရထား ဒီနေ့ လည်း နောက်ကျ ပြန် တယ် လူတွေ စကား ပြော ကြတယ်။",
    "km": "ព្រឹក នេះ រថភ្លើង មក យឺត ម្តង ទៀត ហើយ មនុស្ស គ្រប់ គ្នា និយាយ។",
    "hy": "Առավոտյան գնացքը այսօր նորից ուշացավ և բոլոր մարդիկ խոսում էին։",
    "th": "รถไฟ ตอนเช้า มาสาย อีกแล้ว วันนี้ และ ทุกคน ก็ คุยกัน เรื่อง อากาศ",
    "ja": "今朝 の 列車 は また 遅れ て 来た ので みんな 天気 の 話 を した。",
    "el": "Το πρωινό τρένο άργησε πάλι σήμερα και όλοι μιλούσαν για τον καιρό;",
}


def test_end_marks_of_scripts(spark):
    rows = [(i, "\n".join(f"{t} {t}" if j % 2 else t + " " + chr(0x61 + j) for j in range(3)), lang) for i, (lang, t) in enumerate(SCRIPTS.items())]
    got = {r.lang: r for r in quality.judge(docs(spark, rows)).collect()}
    assert {k: r.n_words_cleaned == r.n_words for k, r in got.items()} == dict.fromkeys(SCRIPTS, True)


def test_quality_long_text(spark):
    text = " ".join(f"w{i}." for i in range(60_000)) + " " + " ".join(f"w{i}." for i in range(100))
    r = quality.judge(docs(spark, [(1, text, None)])).first()
    assert (r.n_words, r.n_repeat_words) == (60_100, 200) and r.kept


# ---- SimHash


def plain_print(text):
    words = [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in [*TEXTS, "one", "One two", "a b c", "ÀB à"]:
        assert simhash.fingerprint(t) == plain_print(t), t


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates_of_a_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op8_simhash"](spark, sf_dir).collect()}
    prints = {i: plain_print(t) for i, t in rows}
    assert {i: int(x, 16) for i, (x, _) in got.items()} == prints and all(len(x) == 16 for x, _ in got.values())
    assert {i: c for i, (_, c) in got.items()} == brute_components(prints)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 20)] + [0, (1 << 64) - 1]
    prints = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    got = {tuple(r) for r in simhash.candidate_links(df).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a in prints for b in prints if a != b and bin(a ^ b).count("1") <= 2}
    assert got == want and want
    linked = {r.node: r.root for r in components.components(simhash.candidate_links(df)).collect()}
    roots = brute_components({signed(x): x for x in prints})
    assert all(linked.get(i, i) == r for i, r in roots.items())


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}
    assert components.components(links.limit(0)).count() == 0


def test_near_duplicate_edges(spark):
    rows = [(9, None, None), (4, "", None), (7, "  \n", None), (3, CLEAN, None), (3, CLEAN, None), (None, CLEAN, None), (None, "all alone in here", None), (2, CLEAN + " indeed", None)]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()), key=str)
    apart = bin(plain_print(CLEAN) ^ plain_print(CLEAN + " indeed")).count("1")
    least = 2 if apart <= 2 else 3
    assert [c for i, c in got if i == 3] == [least] * 2 and (None, least) in got and (2, 2) in got
    assert {c for i, c in got if i in (4, 7, 9)} == {4}
    assert (None, None) in got
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


# ---- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><div class="wrap-7"><aside>Side</aside><div class="story post-12"><h1>Head &amp; line</h1><p>First   paragraph
with <b>bold</b> text &eacute;&#233; and <a href="x">a link</a>.<p>Second one, unclosed<br>after a break.</p><ul><li>Item one is here<li>Item two is here</ul>
<form><input><button>Send</button></form><div class="ad">Buy now</div><p>Third paragraph &lt;tag&gt; is the last one.</p><section class="comments"><p>I liked it very much</p></section></div></div><footer>&copy; me</footer></body></html>"""
MAIN = "Head & line\nFirst paragraph with bold text éé and a link.\nSecond one, unclosed after a break.\nItem one is here\nItem two is here\nThird paragraph <tag> is the last one."


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 3, "x") for i, u, h in rows], "page_id long, url string, html string, n_chars int, path string")


def test_main_text(spark):
    rows = [(i, f"http://a.org/{i}", PAGE.replace("post-12", f"post-{i}")) for i in range(5)] + [(6, "http://a.org/6", PAGE), (6, "http://a.org/6", PAGE), (None, None, PAGE), (7, "nonsense", ""), (8, "http://b.org", None), (9, "http://c.org/", "no tags at all, only words")]
    got = [(r.page_id, r.text) for r in html.extract(pages(spark, rows)).collect()]
    want = [(i, MAIN if h == PAGE or (h and "story" in h) else h or "") for i, _, h in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert html.extract(pages(spark, [])).count() == 0


def test_host_paths_win_over_a_page_that_is_odd(spark):
    side = '<div class="more">' + "<p>A teaser that says a few words more.</p>" * 6 + "</div>"
    story = "<div class='story'>" + "<p>The story of this page goes on for a while here.</p>" * 8 + "</div>"
    rows = [(i, f"https://h.org/{i}", f"<body>{story}</body>") for i in range(6)] + [(9, "https://h.org/9", f"<body>{story.replace('goes on for a while', 'x', 0)}{side}</body>")]
    got = {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()}
    assert "teaser" not in got[9] and got[9].count("story") == 8
    assert [tuple(r) for r in html.host_paths(pages(spark, rows).withColumn("host", html.host(html.F.col("url")))).collect()] == [("h.org", "/body/div.story", 7)]


@pytest.mark.parametrize("classes", ["layout has-sidebar", "content-sidebar-wrap", "page with-header noSidebar", "site-header-fixed"])
def test_wrappers_named_after_their_parts_stay(classes):
    page = f"""<body><div class="{classes}"><div class="menu">Home and away</div><main><h1>Title</h1><p>A sentence of the article.</p><div class="notice">Mind this</div></main>
    <div class="sidebar"><p>Something else that is long, much longer than the article itself is.</p></div></div></body>"""
    assert html.Page(page).text(None) == "Title\nA sentence of the article."


@pytest.mark.parametrize("text", ["<", "<p", "<p class='x", "<script>never ends", "<!-- never ends", "</div></div>", "<div>" * 50_000 + "x" + "</p></div>" * 50_000, "&amp &#x110000; &nope;", "a < b > c"])
def test_broken_pages(text):
    html.Page(text).text(None)


def test_given_pages(spark, sf_dir):
    got = queries()["op5_html"](spark, sf_dir).limit(50).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in got:
        article = re.search("<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.entities.unescape(re.sub("<[^>]*>", " " if 0 else "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1|ul|li|div|blockquote|h2|h3)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


LONG = "<p>" + "A sentence of the body that goes on for a while. " * 20 + "</p>"


@pytest.mark.parametrize(
    "page, outside",
    [
        (f"<body><article><h1>Title</h1><p>The lead.</p><div class=body>{LONG}</div></article><div class=x><p>Elsewhere</p></div></body>", "Elsewhere"),
        (f"<body><article><h1>Title</h1><section>{LONG * 3}</section><section><p>The lead.</p>{LONG}</section></article></body>", "Elsewhere"),
        (f"<body><div class=post><h1>Title</h1><p>The lead.</p><div class=body>{LONG}</div></div><div class=x><p>Elsewhere</p></div></body>", "Elsewhere"),
        (f"<body><div class=wrap><div class=post><h1>Title</h1><p>The lead.</p><div class=body>{LONG}</div></div><div class=x><p><a href=/>Elsewhere</a></p></div></div></body>", "Elsewhere"),
    ],
)
def test_title_and_lead_outside_the_body_stay(spark, page, outside):
    rows = [(i, f"http://a.org/{i}", page) for i in range(3)] + [(9, None, page)]
    for r in html.extract(pages(spark, rows)).collect():
        assert r.text.startswith("Title\n") and "The lead." in r.text and outside not in r.text
        assert r.text.count("goes on") == page.count("goes on")


@pytest.mark.parametrize(
    "inside, want",
    [
        ("<h2 class=legal>Legal matters</h2><p class='comment'>A remark.</p><p class=tags>Of tags.</p><p class=contact>Write to them.</p><p class=feedback>They heard back.</p>", "Legal matters\nA remark.\nOf tags.\nWrite to them.\nThey heard back."),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so.</p>", "Let x=1 be so."),
        ("<header><h1>The title</h1><p>By line</p></header><p>Text.</p>", "The title\nBy line\nText."),
        ("""<p title="a > b">One</p><p title='it"s > c' class="x">Two</p><p title=it's>Three</p>""", "One\nTwo\nThree"),
    ],
)
def test_article_parts_stay(inside, want):
    assert html.Page(f"<body><header>Site</header><nav>Menu</nav><article>{inside}</article><footer>End</footer></body>").text(None) == want


def test_open_quotes_leave_no_markup():
    assert html.Page("""<body><article><p title="it's>One</p><p class='x'>Two</p></article></body>""").text(None) == "One\nTwo"


@pytest.mark.parametrize("piece", ["<p title=\"", "<a href='x", "<a b=\">\" ", "<p title=\"it's>", "<!--", "<div class=\"a", "<h1>", "<div><h1>x", "<script>", "<a \"", "</p"])
def test_long_pages_take_linear_time(piece):
    import time

    began = time.time()
    html.Page("<body><article><p>Text</p>" + piece * (1_000_000 // len(piece)))
    assert time.time() - began < (1.5 if "title" in piece or "href" in piece else 5)


# ---- pipeline


def test_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "simhash_dedup", "packing"]
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        assert after.columns == source.columns, name
        assert after.count() <= kept.count()
        kept = after
    prints = [plain_print(r.text) for r in kept.collect()]
    assert all(bin(a ^ b).count("1") > 2 for i, a in enumerate(prints) for b in prints[:i])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = source.join(labels.where("quality = 1"), "doc_id").where("n_chars > 300").count()
    assert kept.join(labels.where("quality = 1"), "doc_id").count() > 0.7 * good
    assert kept.join(labels.where("quality = 0"), "doc_id").count() <= 0.05 * labels.where("quality = 0").count() + 1
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.select("doc_id").distinct().count() == kept.count()


OTHERS = "score string, kept string, lang_pred string, __row int, row int, fp int, whole string, cleaned int, c0 string, root int, __text string, tags map<string,int>"


def wide(spark, rows):
    """Documents with further columns, named as what the operators make."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine", "mine", "mine", 7, 7, 7, "mine", 7, "mine", 7, "mine", {"a": 1}) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {OTHERS}")


PLAIN = "The morning train was late again, so the people on the platform talked about the weather.\nNobody minded much. The sun was out, and the station has a good bakery."
OTHER = "Rivers carry sand to the sea all year round.\nIn spring they carry more of it, because the snow melts in the hills and every stream is full of water then."


@pytest.mark.parametrize("broadcast", [True, False])
def test_dedup_stage_keeps_one_of_each_group(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(common, "HOT", 3)
    rows = [(5, CLEAN), (2, CLEAN), (2, CLEAN), (None, CLEAN), (None, "other words altogether in this one"), (8, "a third text that stands alone"), (9, None), (10, ""), (11, " \n"), (12, PLAIN), (12, OTHER), (13, PLAIN), (None, "nothing here has an id"), (None, "nothing here has an id")]
    rows += [(20 + i, CLEAN) for i in range(40)]
    df = wide(spark, rows)
    got = corpus_pipeline.simhash_dedup(spark, df, "")
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    want = [(2, CLEAN), (None, "other words altogether in this one"), (8, "a third text that stands alone"), (9, None), (12, PLAIN), (12, OTHER), (None, "nothing here has an id")]
    assert sorted(kept, key=str) == sorted(want, key=str)
    assert all(r.score == "mine" and r.row == 7 and r.tags == {"a": 1} for r in got.collect())
    assert sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.simhash_dedup(spark, df.repartition(7), "").collect()) == sorted(map(str, want))
    assert corpus_pipeline.simhash_dedup(spark, wide(spark, []), "").count() == 0


@pytest.mark.parametrize("stage", ["language_id", "quality_rules", "simhash_dedup"])
def test_stages_pass_all_columns_and_rows_through(spark, stage):
    """Shared ids, no ids, odd texts, repeated rows and clashing columns: the stage's own decisions alone drop rows."""
    rows = [(1, PLAIN), (1, OTHER), (None, CLEAN), (None, CLEAN), (3, None), (4, ""), (5, "12 34 !?"), (6, (PLAIN + "\n") * 1 + " ".join(f"Word {i} of a long text ends here." for i in range(20_000)))]
    df = wide(spark, rows)
    got = dict(corpus_pipeline.STAGES)[stage](spark, df, "")
    assert got.columns == df.columns
    found = got.collect()
    texts = sorted(r.text[:30] for r in found if r.text and r.doc_id != 5)
    copies = 1 if stage == "simhash_dedup" else 2
    assert texts == sorted([PLAIN[:30], OTHER[:30], PLAIN[:30], *[CLEAN[:30]] * copies])
    assert all((r.score, r.kept, r.lang_pred, r["__row"], r.cleaned, r.c0, r["__text"], r.lang) == ("mine", "mine", "mine", 7, 7, "mine", "mine", "en") for r in found)
    assert dict(corpus_pipeline.STAGES)[stage](spark, wide(spark, []), "").count() == 0


def test_packing_stage_edges(spark):
    got = corpus_pipeline.packed(spark, wide(spark, [(1, None), (1, ""), (None, "a b"), (2, PLAIN), (2, PLAIN)]), "").collect()
    assert sorted(str((r.doc_id, r.doc_tokens)) for r in got if r.doc_id != 2 and r.start == 0)[:2] == ["(1, 1)", "(1, 1)"]
    assert sum(r.length for r in got if r.doc_id == 2) == 2 * next(r.doc_tokens for r in got if r.doc_id == 2)
    assert corpus_pipeline.packed(spark, wide(spark, []), "").count() == 0


def test_queries_and_oracles():
    names = {int(re.match(r"op(\d+)_", n)[1]) for n in queries()}
    assert names == set(range(1, 11)) and set(oracle_sql()) <= set(queries())
