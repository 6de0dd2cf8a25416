import re

from quillmatch.llm.quality_lines import passed, quality, repeat_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def brute_repeat(words):
    wins = {}
    for i in range(len(words) - 4):
        wins.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + k for own in wins.values() if len(own) > 1 for i in own for k in range(5)})


def test_repeat_words():
    for text in ("a b c d e a b c d e f", "x " * 20, "a b c d e f g", "a b c d", "", "1 2 3 4 5 6 1 2 3 4 5 7 6 1 2 3 4 5"):
        words = text.encode().split()
        assert repeat_words(words) == brute_repeat(words)


def test_measures_and_verdict(spark):
    own = lambda i: " ".join(f"{chr(97 + i % 26)}{'xyz'[i // 26]}w{k}" for k in range(20))  # noqa: E731  letters, as digits are alike
    rows = [(i, f"Menu bar {i % 10} here for all of you who read pages on this host today\n{own(i)}", "en", "a", 5, None) for i in range(30)]
    rows += [(100 + i, f"Menu bar {i % 10} here for all of you who read pages on this host today\nabc {'x' * i}", "en", "a", 5, None) for i in range(30)]
    rows += [(200, None, None, None, None, None), (201, " \n ", "en", None, 3, None), (202, "a#b $c\na#b $c d\na#b $c", "en", "b", 9, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in quality(docs).collect()}
    for d, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert (got[d]["n_words"], got[d]["word_chars"]) == (len(words), sum(map(len, words)))
        assert got[d]["n_symbols"] == sum((text or "").count(c) for c in "#*$%&|<>")
        assert got[d]["base_failed"] == (len(words) < 10)
    assert got[202]["n_dup_lines"] == 1 and got[200]["n_words"] == 0
    assert all(got[i]["kept"] and got[i]["n_frequent_words"] == 15 for i in range(30))
    assert not got[110]["kept"] and got[110]["n_frequent_words"] == 15
    out = {r["doc_id"]: r for r in passed(docs).collect()}
    assert set(out) == {d for d, r in got.items() if r["kept"]} and passed(docs).columns == docs.columns


def test_copies_are_no_evidence(spark):
    text = "one long line of a document that was copied many times over by others"
    docs = spark.createDataFrame([(i, text, "en", "a", 5, None) for i in range(50)], SCHEMA)
    assert quality(docs).filter("kept").count() == 50
    assert quality(docs.limit(0)).count() == 0 and passed(docs.limit(0)).count() == 0


def test_frequent_lines_go_from_kept_documents(spark):
    menu = "Home News About and many other things"
    rows = [(i, menu + "\n" + " ".join(f"w{i}y{k}" for k in range(20)), "en", "a", 5, None) for i in range(20)]
    out = passed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 20 and all(menu not in r["text"] and r["n_chars"] == len(r["text"]) for r in out)
