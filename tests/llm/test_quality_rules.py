import re
from collections import Counter

from ledgerloom.llm.quality_rules import judged


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(hit)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 50 or 100 * r > 50 * n)


def test_counts_equal_brute_force(odd_docs, odd_texts):
    rows = judged(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 4
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(odd_texts[r.doc_id]), odd_texts[r.doc_id]
            assert r.kept == (not r.base_failed and r.host_kept)


def test_bad_host_loses_its_documents(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good, f"h{i % 5}") for i in range(300)] + [(1000 + i, good if i < 10 else "short", "bad") for i in range(100)] + [(2000, good, None), (2001, "tiny", "new")]
    got = {r.doc_id: r for r in judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows) and got[0].kept and got[2000].kept
    assert not got[1000].kept and not got[1000].base_failed and got[1000].host_rate > 0.5
    assert got[2001].host_rate < 1  # one document alone is shrunk towards the rest


def test_clean_host_of_code_like_texts_stays(spark):
    code = lambda k: "\n".join(f"call{k}_{i} ( first{i} , second{i} ) {{\n  return value{k}_{i} ;\n}}" for i in range(40))
    rows = [(i, code(i), "code") for i in range(60)] + [(100 + i, "\n".join(f"word{j} of {i} other{j} more{j} and{j} last{j}\n)\n)" for j in range(20)), "menus") for i in range(60)] + [(200 + i, " ".join(f"w{i}x{j}" for j in range(90)), "prose") for i in range(300)]
    got = {r.doc_id: r for r in judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept and not got[i].broken and got[i].n_dup_lines == 39 and got[i].n_lines == 120 for i in range(60))
    assert all(got[100 + i].broken and not got[100 + i].base_failed and not got[100 + i].kept for i in range(60))  # the host goes, not the base


def test_plan_has_no_python(odd_docs):
    rows = judged(odd_docs)
    assert "Python" not in rows._jdf.queryExecution().toString() and "Arrow" not in rows._jdf.queryExecution().toString()


def test_no_rows(no_docs):
    assert judged(no_docs).collect() == []
