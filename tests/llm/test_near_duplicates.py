"""Near duplicates against a comparison of all pairs."""

from __future__ import annotations

import random

from joulegrid.llm import nearsets, simhash


def word(r: random.Random) -> str:
    return "".join(r.choices("abcdefghijklmno", k=r.randrange(2, 9)))


def shingles(text: str) -> set[tuple[str, ...]]:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar(a: str, b: str) -> bool:
    p, q = shingles(a), shingles(b)
    return 5 * len(p & q) >= 4 * len(p | q)


def kept(spark, rows) -> list[int]:
    return sorted(r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_appended_truncated_and_replaced_blocks_are_found(spark):
    r = random.Random(3)
    rows, want = [], []
    for g in range(60):
        n = (60, 150, 400)[g % 3]
        base = [word(r) for _ in range(n)]
        block = (n - 4) // 9 - 4
        at = r.randrange(n - block)
        other = (base + [word(r) for _ in range(n // 5 - 1)], base[: -(n // 5) + 1], base[:at] + [word(r) for _ in range(block)] + base[at + block :])[g // 3 % 3]
        assert similar(" ".join(base), " ".join(other))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
        want.append(2 * g)
    assert kept(spark, rows) == want


def test_texts_unlike_the_head_of_their_bucket_meet_each_other(spark):
    r = random.Random(4)
    rows, want = [], []
    for g in range(20):
        sentences = [[word(r) for _ in range(6)] for _ in range(12)]
        turned = sentences[::-1]
        r.shuffle(turned)
        swapped = [w for s in turned for w in s]
        swapped[30], swapped[31] = swapped[31], swapped[30]
        a, b, c = (" ".join(w for s in sentences for w in s), " ".join(w for s in turned for w in s), " ".join(swapped))
        assert not similar(a, b) and not similar(a, c) and similar(b, c)
        rows += [(3 * g, a), (3 * g + 1, b), (3 * g + 2, c)]
        want += [3 * g, 3 * g + 1]
    assert kept(spark, rows) == want


def test_groups_of_a_shared_passage_equal_all_pairs(spark):
    r = random.Random(5)
    passages = [[word(r) for _ in range(40)] for _ in range(4)]
    texts = []
    for i in range(80):  # a bucket holds many texts, of several groups, in chains
        text = [w for p in sorted(r.sample(range(4), 3)) for w in passages[p]]
        for p in r.sample(range(len(text)), r.randrange(4)):
            text[p] = word(r)
        texts.append(" ".join(text))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if similar(texts[a], texts[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert kept(spark, list(enumerate(texts))) == sorted(set(root))


def test_repeated_lines_do_not_part_equal_shingle_sets(spark):
    r = random.Random(6)
    rows = []
    for g in range(10):
        body, line = [word(r) for _ in range(80)], [word(r) for _ in range(12)]
        rows += [(2 * g, " ".join(body + line + line)), (2 * g + 1, " ".join(body + line * 60))]
        assert shingles(rows[-1][1]) == shingles(rows[-2][1])
    assert kept(spark, rows) == list(range(0, 20, 2))


def test_different_texts_under_one_id_are_judged_apart(spark):
    r = random.Random(7)
    a, b, c = (" ".join(word(r) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, b), (4, a)]
    left = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["text"]) for x in left) == sorted([(1, a), (2, b), (3, c)])


def test_similar_texts_are_proposed_by_their_fingerprints(spark):
    prints = spark.createDataFrame([(5, 0b1000), (6, 0b1000), (7, 0b1011), (8, 0b1111 << 20)], "node long, fp long")
    pairs = {(r["a"], r["b"]) for r in simhash.ball_pairs(prints).collect()}
    assert (6, 5) in pairs and {frozenset(p) for p in pairs} == {frozenset((5, 6)), frozenset((5, 7))}

    r = random.Random(8)
    near = 64
    while near > 2:  # one word more moves few bits of a long text
        words = [word(r) for _ in range(1500)]
        pair = [" ".join(words), " ".join(words[:750] + ["new"] + words[750:])]
        near = (simhash.fingerprint(pair[0], 5) ^ simhash.fingerprint(pair[1], 5)).bit_count()
    rows = [(1, pair[0]), (2, pair[1]), (3, " ".join(word(r) for _ in range(60)))]
    proposed = []

    def balls(nodes):
        found = simhash.ball_pairs(nodes)
        proposed.extend(found.collect())
        return found

    groups = nearsets.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), balls).collect()
    root = {g["doc_id"]: g["root"] for g in groups}
    assert root[1] == root[2] != root[3]
    assert len(proposed) == 1
