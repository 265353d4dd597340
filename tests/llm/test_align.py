"""Alignment of two tokenizers against all pairs of byte ranges."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turfline.llm import align as al

TEXTS = [
    "The quick brown fox's 1234 jumps, über naïve façades.", "hello  world\n\tx ", " lead <|endoftext|> and <s> </s> <unk> <0x41>", "日本語のテキスト 🙂🙂",
    "a▁b mark", "", None, "x" * 5000, "ﬁne ｆｕｌｌ   é", "The quick brown fox's 1234 jumps, über naïve façades.", "\r\n\x00\x07", "long words " * 20_000,
]


def spans(ends):
    return list(zip([0, *ends], ends))


def plain(texts):
    """Groups by walking all byte offsets, links by comparing ranges near each other, counts over all texts."""
    a, b = al.byte_level(), al.pieces()
    rows = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a_ids = a.encode([" " + text])[0] if text else []
        b_ids = b.encode([" " + text])[0] if text else []
        if b"".join(a.entries[i] for i in a_ids) != raw or b"".join(b.entries[i] for i in b_ids) != raw:
            a_ids, b_ids = [], []
        ends = [[sum(lengths[:i]) for i in range(1, len(lengths) + 1)] if len(lengths) < 3000 else list(al.accumulate(lengths)) for lengths in ([len(a.entries[i]) for i in a_ids], [len(b.entries[i]) for i in b_ids])]
        groups, held = [], [[], []]
        owner = [{e: i for e, i in zip(ends[s], ids)} for s, ids in ((0, a_ids), (1, b_ids))]
        for offset in range(1, len(raw) + 1):
            hit = [offset in owner[s] for s in (0, 1)]
            for s in (0, 1):
                if hit[s]:
                    held[s].append(owner[s][offset])
            if all(hit):
                groups.append("|".join(",".join(map(str, h)) for h in held))
                held = [[], []]
        a_of = [i for i, (lo, hi) in enumerate(spans(ends[0])) for _ in range(lo, hi)]
        b_of = [i for i, (lo, hi) in enumerate(spans(ends[1])) for _ in range(lo, hi)]
        links = [(a_ids[i], b_ids[j]) for i, j in sorted(set(zip(a_of, b_of)))]
        rows.append((len(a_ids), len(b_ids), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    counts = Counter(p for r in rows for p in r[3])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return sorted((na, nb, ng, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha) for na, nb, ng, links, sha in rows)


@pytest.mark.parametrize("hot", [1, 200_000])
def test_equals_all_ranges(spark, monkeypatch, hot):
    monkeypatch.setattr(al, "HOT_SHARE", hot)
    schema = "text string, n_a string, count_sum string, alignment string, cold int"
    df = spark.createDataFrame([(t, "x", "y", "z", 1) for t in TEXTS], schema).repartition(3)
    out = al.link_counts(df, keep_groups=True)
    assert len(set(out.columns)) == len(out.columns)
    got = out.select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(tuple(r) for r in got.collect()) == plain(TEXTS)
    texts = out.where(F.size("alignment") > 0).select(F.sha2(F.concat_ws(";", "alignment"), 256).alias("s"), "groups_sha256")
    assert texts.where("s <> groups_sha256").count() == 0
    assert al.link_counts(df.limit(0)).count() == 0


def test_cuts_and_links():
    a, b = [2, 5, 7, 9], [1, 5, 6, 8, 9]
    assert al.cuts(a, b) == ([5, 9], [2, 4], [2, 5])
    got = al.align_ids([1, 2, 3, 4], [5, 6, 7, 8, 9], a, b, al.Labels(10, 10))
    assert got.text == "1,2|5,6;3,4|7,8,9;" and got.chars_upto.tolist() == [8, 18]
    pairs = [(1, 5), (1, 6), (2, 6), (3, 7), (3, 8), (4, 8), (4, 9)]
    assert [(p >> 32, p % (1 << 32)) for p in got.links.tolist()] == pairs and got.links_upto.tolist() == [3, 7]


def test_symbols_cover_all_bytes():
    assert sorted(al.byte_of_symbol().values()) == list(range(256))


@pytest.mark.parametrize("kept", [3, 100_000])
def test_words_are_aligned_as_the_whole_text_is(monkeypatch, kept):
    monkeypatch.setattr(al, "KEPT_WORDS", kept)
    a, b = al.byte_level(), al.pieces()
    assert a.by_word and b.by_word
    by_word, whole = al.Words(a, b), al.Words(a, b)
    whole.by_word = False
    odd = ["a\x1c b\x85 c\u3000 d\xa0 e \u200b f", "x  y   z \n w", "it's 'll we 've", "tab\t space", "1 2 34 five6 7", "é e\u0301 ok", "mark ▁ here", "trail ", " \n"]
    texts = [t for t in TEXTS if t] + odd

    def plain(rows):
        return [(*r[:5], r[5].tolist(), r[6].tolist()) for r in rows]

    for text in texts:
        assert plain(by_word.align([text])) == plain(whole.align([text]))
    assert plain(by_word.align(texts)) == plain(whole.align(texts))
