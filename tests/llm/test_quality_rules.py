import re
from collections import Counter

from sparkmill.llm import quality_rules

SCHEMA = "doc_id long, text string, source string, n_words int, host string"


def plain(text):
    text = text or ""
    ws = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    seen = Counter(grams)
    covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "one", "a b c", "a b c a b c", "x " * 100, "a b a b a b a", "l\nl\n\nl\r\n l", "é\x85ü\u2003ö #*$%&|<>", "w\x1cx\x0by", " ".join(f"w{i}" for i in range(60)), "rep rep2 rep3 " * 9 + " ".join(f"v{i}" for i in range(80)), "big " * 20_000]


def test_counts(spark):
    rows = [(i, t, f"s{i % 3}", 0, "h") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "s1", 0, "h"), (None, "null id", None, 0, "h")]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain(text)
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r.kept and r.base_failed)


def test_hosts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", "good", 0, "") for i in range(400)] + [(1000 + i, "short" if i % 20 else good, "bad", 0, "") for i in range(200)] + [(2000, good, "new", 0, ""), (2001, "short", None, 0, "")]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i].kept == bool(i % 10) for i in range(400))
    assert not any(out[1000 + i].kept for i in range(200))
    assert out[2000].kept and 0 < out[2000].host_rate < 0.5
    assert 0.5 < out[2001].host_rate < 1
    big = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert big == {k: r.kept for k, r in out.items()}


def test_no_rows(spark):
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hosts_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(60)), f"h{i}" if i % 7 else None, 0, "") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, quality_rules.quality_rules(docs).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", 3)
    assert sorted(map(str, quality_rules.quality_rules(docs).collect())) == want
