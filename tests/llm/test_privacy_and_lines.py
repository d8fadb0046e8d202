import random
import re

from inkwell.llm import line_rules, privacy

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in match.split("."))) or (kind == "phone" and 9 <= len(digits) <= 15)


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_base_spans_equal_the_patterns(spark, odd_docs):
    rnd = random.Random(10)
    bits = ["1", "4111 1111 1111 1111", "a@b.co", "_x@y.zz", ".", "+1 (407) 555-89", "3", " ", "-", "é", "@", "1.2.3.4", "256", "+", "a.b", "\n", "00", "12"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(1200)]
    texts += [None, "", "1 " * 30000, "9" * 30000, "a." * 30000 + "@", "x@" + "a." * 9000 + "b", "+1" + " 2" * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r._base] for r in privacy.with_base_spans(docs).select("doc_id", "_base").collect()}
    assert all(got[i] == base_spans(t) for i, t in enumerate(texts))


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"words here call me at +1 (4{i % 90 + 10}) 555-{1000 + i} or so") for i in range(40)]
    rows += [(100 + i, f"some text please call me at 0{i}71 55512{i:02d} or so thanks") for i in range(10)]
    rows += [(200 + i, f"the year was 19{i:02d} 2000 and") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r._spans] for r in privacy.find_personal_data(docs).collect()}
    assert all(found[100 + i] == [("phone", f"0{i}71 55512{i:02d}")] for i in range(10))
    assert all(found[200 + i] == [] for i in range(20)) and all(len(found[i]) == 1 for i in range(40))
    clean = {r.doc_id: r.text for r in privacy.redact(docs).collect()}
    assert clean[3] == "words here call me at [phone] or so" and clean[101] == "some text please call me at [phone] or so thanks"
    assert clean[205] == rows[55][1]


def test_odd_documents(spark, odd_docs, no_docs):
    rows = privacy.find_personal_data(odd_docs).select("doc_id", "text", "_spans").collect()
    assert len(rows) == odd_docs.count()
    assert all([(s.kind, s.start, s.end) for s in r._spans] == base_spans(r.text) for r in rows)
    assert privacy.redact(odd_docs).columns == odd_docs.columns and privacy.redact(no_docs).count() == 0
    lines = line_rules.clean_lines(odd_docs).collect()
    assert len(lines) == odd_docs.count() and line_rules.clean_lines(no_docs).count() == 0


def repeated(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)})


def test_counts_of_lines(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(["a b", " ", "\n", "c d e f", "x|", "#", "é", "\t", "b a c d e f g h "]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in line_rules.clean_lines(docs).collect():
        text = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == repeated(words)
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))


def test_lines_that_fail(spark):
    good = "This is a sentence of good text, which ends well."
    rows = [
        (0, "\n".join([good, "Home | About | Contact", "BUY NOW AND SAVE BIG", "Menu", good, "Please accept cookies to go on with this page."])),
        (1, "\n".join([f"Line {i} has v{i} w{i} x{i} y{i} z{i} and ends." for i in range(9)] + ["Menu"])),
        (2, "\n".join(f"nav{i} | link{i} | item{i} | more{i}" for i in range(20))),
    ]
    got = {r.doc_id: r for r in line_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].clean_text == good and sorted(got[0].faults) == ["boilerplate", "capitals", "navigation", "punctuation"]
    assert got[1].kept and "Menu" not in got[1].clean_text and not got[2].kept
