import random

from chainlake.llm.decontamination import decontaminate


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, True) for i, t in docs], "doc_id long, text string, contaminated boolean").repartition(3)
    return {r.doc_id: r for r in decontaminate(d, spark.createDataFrame(items, "item_id long, text string")).collect()}


ITEMS = [
    (1, "Yesterday the baker Mary sold 12 loaves for 5 dollars each and then Mary bought 12 bags of flour, so how many coins are left?"),
    (2, "Boil the water, add salt and stir well."),
    (3, "Too short item."),
    (4, None),
]


def test_exact_reworded_and_inconsistent(spark):
    other = ITEMS[0][1].replace("Mary", "Peter").replace("12", "40").replace("5 dollars", "7 euros")
    uneven = ITEMS[0][1].replace("sold 12", "sold 40").replace("Mary bought", "Peter bought")
    r = random.Random(0)
    noise = " ".join("".join(r.choice("abcdefg") for _ in range(4)) for _ in range(400))
    docs = [
        (1, f"{noise} {ITEMS[0][1]} {noise}"), (2, f"{noise}\n{other}\n{noise}"), (3, f"{noise} {uneven} {noise}"), (4, noise), (5, None), (6, ""), (7, "BOIL THE WATER,!! ADD SALT*** AND STIR WELL."),
        (8, " ".join(ITEMS[0][1].split()[:8])), (9, " ".join(ITEMS[0][1].split()[3:20])), (10, "Too short item."), (11, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (12, noise * 50 + " " + ITEMS[1][1]), (1, f"{noise} {ITEMS[0][1]} {noise}"),
    ]
    got = run(spark, docs, ITEMS)
    assert {i for i, g in got.items() if g.contaminated} == {1, 2, 7, 9, 12}
    assert got[2].reworded and not got[1].reworded and got[1].item_ids == [1] and got[12].item_ids == [2]


def test_nothing_to_compare(spark):
    assert not run(spark, [(1, ITEMS[0][1]), (None, ITEMS[0][1])], ITEMS[3:])[1].contaminated
    assert not run(spark, [(None, ITEMS[0][1])], ITEMS)[None].contaminated
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate(empty, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert decontaminate(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).first().contaminated is False


def test_large_benchmarks_join_every_window(spark, monkeypatch):
    from chainlake.llm import decontamination

    docs = [(1, ITEMS[0][1]), (2, "nothing of that")]
    want = run(spark, docs, ITEMS)
    monkeypatch.setattr(decontamination, "FILTER_WINDOWS", 0)
    assert run(spark, docs, ITEMS) == want


def test_items_of_many_slots_match_by_their_own_tokens(spark, monkeypatch):
    from chainlake.llm import decontamination

    dense = "Anna has 3 apples, Peter 4, Maria 5: how many together?"
    table = "12 14 16 18 and 22 24 26 28 30 32 34 36"
    items = [(1, dense), (2, table)]
    docs = [(1, dense), (2, f"some words before. {dense} and after"), (3, dense.replace("3", "7")), (4, f"so it is {table} there"), (5, table.replace("2", "5")), (6, f"the word that {dense}")]
    got = run(spark, docs, items)
    assert {i for i, g in got.items() if g.contaminated} == {1, 2, 4, 6}
    assert not any(g.reworded for g in got.values())
    monkeypatch.setattr(decontamination, "FILTER_WINDOWS", 0)
    assert run(spark, docs, items) == got


def tokens(text, opening):
    """(own, template) of each token, in plain Python."""
    import string

    from chainlake.llm import decontamination as x
    from chainlake.llm.surrogates import GIVEN

    names = {n.lower() for group in GIVEN.values() for n in group}
    solid = lambda c: c not in string.punctuation.replace("$", "").replace("%", "") and not c.isspace()
    kept = [(i, c) for i, c in enumerate(text) if solid(c) or c.isspace() or 0 < i < len(text) - 1 and solid(text[i - 1]) and solid(text[i + 1])]
    words, now = [], []
    for i, c in [*kept, (len(text), " ")]:
        if c.isspace():
            words += [now] if now else []
            now = []
        else:
            now.append((i, c))
    out, last, before = [], 0, False
    for k, word in enumerate(words):
        raw = "".join(c for _, c in word)
        own = raw.lower()
        opens = opening if k == 0 else any(c in "!.:?\n" for c in text[last : word[0][0]])
        number = any(c.isdigit() for c in raw) and all(c.isdigit() or c in string.punctuation for c in raw)
        title = raw[0] in string.ascii_uppercase and len(raw) > 1 and raw[1] in string.ascii_lowercase
        unit = own in x.UNITS and (before and not opens or len(raw) > 3)
        out.append((own, "#number" if number else "#unit" if unit else "#name" if title and not opens or own in names else own))
        last, before = word[-1][0] + 1, number
    return out


def plain(docs, items):
    """{doc: items that contaminate it}, every window of every pair compared."""
    from itertools import product

    def windows(text, opening, sizes, item):
        t = tokens(text, opening)
        for n in sizes:
            for i in range(len(t) - n + 1):
                w = t[i : i + n]
                slots = [k for k in range(n) if w[k][1].startswith("#")]
                literal = len(slots) < n / 2
                if literal:
                    yield n, i, ("t", *(b for _, b in w)), tuple(w[k][0] for k in slots)
                if not literal or not item:
                    yield n, i, ("o", *(a for a, _ in w)), tuple(a for a, _ in w)

    found = {}
    for (d, text), (i, item) in product(docs, items):
        n_item = len(tokens(item or "", True))
        if n_item < 5:
            continue
        size = min(n_item, 10)
        mine = {w for opening in (True, False) for w in windows(item, opening, [size], True)}
        diagonals = {}
        for (n, a, key, slots), (_, b, other, have) in product(mine, windows(text or "", True, [size], False)):
            if key == other:
                places, pairs = diagonals.setdefault(b - a, (set(), set()))
                places |= set(range(a, a + n))
                pairs |= set(zip(slots, have, strict=True))
        if any(len({p for p, _ in pairs}) == len(pairs) and len(places) >= min(13, n_item) for places, pairs in diagonals.values()):
            found.setdefault(d, set()).add(i)
    return found


def test_equals_plain_comparison(spark):
    r = random.Random(7)
    words = ["bread", "water", "the", "coins", "many", "sold", "left", "every", "green", "slowly", "were", "bags"]
    word = lambda: r.choice([*words, *words, str(r.randint(1, 60)), r.choice(["Mary", "Peter", "Quentin"]), r.choice(["kg", "dollars", "minutes"])])
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + r.choice([".", "?", "!", ""])
    items = [(i, sentence(r.choice([4, 6, 9, 12, 20, 30]))) for i in range(14)] + [(50, None), (51, "")]
    docs = []
    for d in range(90):
        i, text = r.choice(items[:14])
        part = text.split()
        if d % 3 == 1:
            swap = {str(n): str(n + 100) for n in range(61)} | {"Mary": "Peter", "Peter": "Mary", "kg": "minutes"}
            part = [swap.get(w, w) for w in part]
        if d % 3 == 2 and len(part) > 6:
            part[r.randrange(len(part))] = word()
        docs.append((d, f"{sentence(r.randint(0, 12))} {' '.join(part)} {sentence(r.randint(0, 12))}"))
    want = plain(docs, items)
    got = {d: set(g.item_ids) for d, g in run(spark, docs, items).items() if g.contaminated}
    assert got == want and 20 < len(want) < 80


def test_reparameterised_sums_and_number_words(spark):
    """Sums keep the shape of their terms; the same number has to stand for the same; number words are numbers."""
    items = spark.createDataFrame([(1, "What is 12 + 30 * 4 - 6 ?"), (2, "Each of the seven dwarfs carries three heavy bags over twenty small hills, so how many bags?"), (3, "Work out 5 * 5 + 5 - 2 = 28 by hand, then check")], "item_id long, text string")
    texts = {
        10: "Well: what is 15 + 22 * 9 - 7 ?", 11: "What is 15 - 22 * 9 + 7 ?", 12: "what is 15 22 9 7", 13: "Each of the 9 dwarfs carries five heavy bags over 31 small hills, so how many bags?",
        14: "Each of the nine dwarfs eats three heavy meals under twenty small hills, so how many meals?", 15: "Work out 7 * 7 + 7 - 2 = 54 by hand, then check", 16: "Work out 7 * 8 + 9 - 2 = 63 by hand, then check", 17: "1 +", 18: "- 1", 19: "+ 2 * 3",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_ids, r.reworded) for r in decontaminate(docs, items).collect()}
    assert got[10] == (True, [1], True) and got[13] == (True, [2], True) and got[15] == (True, [3], True)
    assert not any(got[i][0] for i in (11, 12, 14, 16, 17, 18, 19))
