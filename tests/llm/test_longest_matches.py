"""Longest matches beyond the depth of the arrays, and their ties."""

from strandline.llm import decontamination


def longest(spark, docs, items):
    rows = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = decontamination.longest_matches(rows, spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.item_id, r.item_word): (r.n_words, r.doc_id, r.doc_word) for r in found}


def brute(docs, items, least=4):
    out = {}
    for name, item in items:
        w = item.split()
        for i in range(len(w)):
            best = []
            for doc_id, text in docs:
                t = text.split()
                for p in range(len(t)):
                    n = 0
                    while i + n < len(w) and p + n < len(t) and w[i + n] == t[p + n]:
                        n += 1
                    best.append((-n, doc_id, p))
            n, doc_id, p = min(best)
            if -n >= least:
                out[str(name), i] = (-n, doc_id, p)
    return out


def words(start, n):
    return " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(start, start + n))


def test_item_of_200_words_copied_whole(spark):
    docs = [(3, words(0, 64)), (9, "zz " + words(0, 200) + " yy"), (11, words(100, 90))]
    items = [(1, words(0, 200))]
    got = longest(spark, docs, items)
    assert got["1", 0] == (200, 9, 1) and got == brute(docs, items)


def test_ties_take_the_smallest_document_and_place(spark):
    docs = [(8, "q " + words(0, 5)), (7, words(0, 5) + " x " + words(0, 5)), (2, "a a " + words(0, 5) + " q " + words(0, 5)), (5, words(0, 5) + " ab")]
    items = [(1, words(0, 5)), (2, words(0, 70)), (3, words(0, 5) + " zz")]
    got = longest(spark, docs, items)
    assert got["1", 0] == got["3", 0] == (5, 2, 2) and got == brute(docs, items)
