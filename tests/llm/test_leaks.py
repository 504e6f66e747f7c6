import random

import pytest

from strataloom.llm import leaks as L


def brute(docs, items, words=12):
    out = set()
    for d, text in docs:
        w = L.words_of(text or "")
        for i, item in items:
            v = L.words_of(item or "")
            k = min(words, len(v))
            if k and any(w[a : a + k] == v[b : b + k] for b in range(len(v) - k + 1) for a in range(len(w) - k + 1)):
                out.add((d, i))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rnd.choice([1, 3, 8, 12, 30])))) for i in range(12)]
    items += [(100, items[3][1]), (101, ""), (102, None), (103, "--- !!")]
    docs = []
    for d in range(60):
        w = say(rnd.randint(0, 80))
        if d % 3 == 0:
            src = items[rnd.randrange(12)][1].split()
            cut = src[: rnd.randint(1, len(src))]
            at = rnd.randint(0, len(w))
            w[at:at] = cut
        sep = rnd.choice([" ", "\n# ", " -- ", "_"])
        docs.append((d, sep.join(w).upper() if d % 5 == 0 else sep.join(w)))
    return [*docs, (900, None), (901, ""), (902, "x" * 200_000)], items


@pytest.mark.parametrize("seed,block", [(1, 10**6), (2, 20)])
def test_against_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "'x' as item_id")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id")
    got = {tuple(r) for r in L.leaked(d, i, block_words=block).collect()}
    assert got == brute(docs, items)
    assert L.leaked(d.limit(0), i).collect() == [] and L.leaked(d, i.limit(0)).collect() == []


def edited(rnd, words, kind):
    """The words with one edit that leaves no twelve of them in a row."""
    w, at = list(words), rnd.randrange(1, len(words) - 1)
    if kind == "replaced":
        w[at] = "t500" if rnd.random() < 0.5 else "strange"
    elif kind == "left out":
        del w[at]
    else:
        w.insert(at, f"t{rnd.randrange(500)}" if rnd.random() < 0.5 else "strange")
    return w


def near(a, b, most):
    """Whether two lists are within *most* edits, by looking at all ways."""
    if not a or not b:
        return len(a) + len(b) <= most
    if a[0] == b[0]:
        return near(a[1:], b[1:], most)
    return most > 0 and (near(a[1:], b[1:], most - 1) or near(a[1:], b, most - 1) or near(a, b[1:], most - 1))


def leaks_with_edits(text, item, words, most):
    w, v = L.words_of(text), L.words_of(item)
    k = min(words, len(v))
    e = L.edits_of(k, most)
    return any(near(w[i : i + n], v[j : j + k], e) for j in range(len(v) - k + 1) for n in range(k - e, k + e + 1) for i in range(len(w) - n + 1))


@pytest.mark.parametrize("kind", ["replaced", "left out", "put in"])
def test_recall_with_one_edit(kind):
    # items of just the window's size: equality of windows finds none of them
    rnd = random.Random(5)
    items = [(i, " ".join(f"t{rnd.randrange(500)}" for _ in range(12))) for i in range(300)] + [(300, "t500")]
    index = L.ItemIndex(items, 12, 1, L.EDIT_REPETITIONS, L.EDIT_SAMPLED, 7)
    exact = L.ItemIndex(items, 12, 0, 1, 8, 7)
    hit = wanted = 0
    for key, text in items[:300]:
        body = "t1 noise words here " + " ".join(edited(rnd, text.split(), kind)) + " and more t2"
        assert leaks_with_edits(body, text, 12, 1)
        wanted += 1
        hit += key in set(index.found(body))
        assert key not in set(exact.found(body))
    assert hit >= 0.95 * wanted


def test_two_edits_and_short_items():
    rnd = random.Random(6)
    items = [(i, " ".join(f"t{rnd.randrange(500)}" for _ in range(12))) for i in range(200)]
    index = L.ItemIndex(items, 12, 2, 4 * L.EDIT_REPETITIONS, L.EDIT_SAMPLED, 7)
    hit = 0
    for key, text in items:
        w = edited(rnd, edited(rnd, text.split(), "replaced"), rnd.choice(["left out", "put in"]))
        hit += key in set(index.found("so " + " ".join(w) + " it goes"))
    assert hit >= 0.9 * len(items)
    # an item of three words admits no edit
    few = L.ItemIndex([(0, "one two three")], 12, 2, 8, 4, 7)
    assert list(few.found("one two four")) == [] and list(few.found("x one two three y")) == [0]


def test_edited_leaks_against_brute_force(spark):
    rnd = random.Random(8)
    items = [(i, " ".join(f"t{rnd.randrange(60)}" for _ in range(rnd.choice([2, 5, 12, 14])))) for i in range(20)] + [(50, "t1 t1")]
    docs = []
    for d in range(80):
        w = [f"t{rnd.randrange(60)}" for _ in range(rnd.randrange(30))]
        if d % 2:
            v = items[rnd.randrange(20)][1].split()
            w[3:3] = edited(rnd, v, rnd.choice(["replaced", "left out", "put in"])) if len(v) > 2 else v
        docs.append((d, " ".join(w)))
    want = {(d, i) for d, text in docs for i, item in items if leaks_with_edits(text, item, 12, 1)}
    got = {tuple(r) for r in L.leaked(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), max_edits=1).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 20


def test_shared_windows_and_repeats():
    same = " ".join(f"w{i}" for i in range(12))
    index = L.ItemIndex([(i, same) for i in range(5)] + [(9, None)], 12, 0, 1, 8, 7)
    assert len(index.tables[0][3]) == 1 and sorted(index.found(f"{same} {same}")) == [0, 1, 2, 3, 4]
    assert list(index.found(" ".join(same.split()[1:]))) == []


def test_within():
    assert L.within([1, 2, 3], [1, 3], 1) and not L.within([1, 2, 3], [3, 1], 1) and L.within([], [1], 1) and L.within([1, 2], [1, 2], 0) and not L.within([1, 2, 3], [1], 1)
