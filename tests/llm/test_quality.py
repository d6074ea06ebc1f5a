import re

from detlake.llm.quality import RULES, SYMBOLS, quality_rules
from tests.llm.helpers import awkward_rows, clashing, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text or "")
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(SYMBOLS, text or "")),
        len(lines) - len(set(lines)), len(repeated),
    )


def test_measures_equal_a_plain_count(spark):
    rows = awkward_rows() + [
        (20, "a b c a b c\na b c\n\na b c", "en", "a", 1),
        (21, "w " * 500, "en", "a", 1),
        (22, "a  b\x0bc # $ |x|\r\nq\r\nq", "en", "a", 1),
    ]
    got = quality_rules(documents(spark, rows)).select("text", "measures.*", "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        want = counted(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_rules_name_what_is_broken(spark):
    good = " ".join(f"the word{i} of house{i}" for i in range(30))
    rows = [
        (1, good, None, None, 0),
        (2, " ".join(f"the&&& word{i}*** of$$$ house{i}" for i in range(30)), None, None, 0),
        (3, " ".join(f"word{i} house{i}" for i in range(60)), None, None, 0),
    ]
    got = {r.doc_id: r for r in quality_rules(documents(spark, rows)).collect()}
    assert got[1].kept and got[1].broken == []
    assert not got[2].kept and "symbols_per_word" in got[2].broken
    assert not got[3].kept and got[3].broken == ["stop_words"]
    assert {r.name for r in RULES} >= {"symbols_per_word", "stop_words", "duplicate_lines"}


def test_clashes_and_empty_table(spark):
    df = clashing(documents(spark), "measures", "kept", "row", "t", "w", "lines")
    got = quality_rules(df)
    assert got.count() == len(awkward_rows()) and got.filter("kept").count() >= 3
    assert {"row", "t", "w", "lines", "a b.c"} <= set(got.columns)
    assert quality_rules(documents(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = quality_rules(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
