import numpy as np
import public_tokenizers
from conftest import SMALL

from awkward import none, odd  # noqa: F401
from docquarry.llm import language_id as g

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    rows = g.language_ids(docs, VOCABULARY).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.98


def test_odd_rows(odd, none):
    rows = g.language_ids(odd, VOCABULARY).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.lang_pred for r in rows}
    assert [by[i] for i in (1, 2, 3)] == ["und"] * 3 and by[4] == "en"
    assert g.language_ids(none, VOCABULARY).count() == 0
    assert g._LETTER.search("² ½ 7 _ !") is None and g._LETTER.search("ß")
    nothing = g.language_ids(odd.drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang"), VOCABULARY)
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "x"]
    p = np.array([[0.3, 0.2], [0.2, 0.1], [0.1, 0.3], [0.1, 0.1], [0.2, 0.2], [0.1, 0.1]])

    def total(word, lang):
        if not word:
            return 1.0
        found = [p[i, lang] * total(word[len(x) :], lang) for i, x in enumerate(pieces) if word.startswith(x)]
        return sum(found) + (g.UNKNOWN * total(word[1:], lang) if word[0] not in pieces else 0)

    words = ["aba", "abab", "bxa", "q", "aqb"]
    got = g.forward(words, g.Prefixes(pieces), p)
    assert np.allclose(got, [[np.log(total(w, lang)) for lang in (0, 1)] for w in words])


def test_letters_outside_the_vocabulary_are_told_apart(spark):
    pick = np.random.default_rng(4)

    def text(first):  # Gothic and Deseret letters, in words of the same lengths
        return " ".join("".join(chr(first + int(x)) for x in pick.integers(0, 16, 5)) for _ in range(20))

    rows = [(i, text((0x10330, 0x10400)[i % 2]), ("got", "dsr")[i % 2]) for i in range(60)]
    got = g.language_ids(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCABULARY).collect()
    assert all(r.lang_pred == ("got", "dsr")[r.doc_id % 2] and r.score > 0.9 for r in got)


def test_bytes_of_code_points_that_are_no_piece():
    p = np.array([[0.3, 0.2], [1e-3, 2e-3], [3e-3, 4e-3]])
    fallback = np.full(256, -1)
    fallback[0xC3], fallback[0xA9] = 1, 2
    got = g.forward(["aé", "aê"], g.Prefixes(["a", "", ""]), p, fallback)
    assert np.allclose(got, np.log([[0.3 * 3e-6, 0.2 * 8e-6], [0.3 * g.UNKNOWN, 0.2 * g.UNKNOWN]]))


def test_long_words_sum_over_all_segmentations():
    pieces = ["a", "b", "ab", "bab"]
    p = np.array([[0.3, 0.2], [0.2, 0.1], [0.1, 0.3], [0.01, 0.1]])
    for word in ("ab" * 500, "q" * 3000 + "ab"):
        sums = [np.ones(2)] + [np.zeros(2)] * len(word)
        scale = np.zeros(2)
        for j in range(1, len(word) + 1):
            total = sum((sums[j - len(x)] * p[i] for i, x in enumerate(pieces) if word[:j].endswith(x)), np.zeros(2))
            total = total + (sums[j - 1] * g.UNKNOWN if word[j - 1] == "q" else 0)
            scale += np.log(total)
            sums[max(0, j - 3) : j] = [s / total for s in sums[max(0, j - 3) : j]]
            sums[j] = np.ones(2)
        got = g.forward(["ab", word, "b"], g.Prefixes(pieces), p)
        assert np.allclose(got[1], scale) and got[1][0] != got[1][1]
        assert np.allclose(got[2], np.log(p[1]))
