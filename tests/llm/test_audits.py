"""The set join, the divergence audit and the filter audit: against brute force, and over odd tables."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string"
LONG = "Alpha beta gamma delta " * 5000
ODD = [
    (1, None, None, None), (2, "", "en", "s"), (3, "same text here, the very same one #1", "en", "s"), (3, "same text here, the very same one #1", "en", "s"),
    (None, "same text here, the very same one #1", "en", None), (None, "No id at all\nbut two lines of text", None, "s"), (4, LONG, "en", "t"), (5, " \t\n\x0b \r\n", "en", "s"),
    (6, "É\x00ñ \U0001f600 word's <|endoftext|> 12345  x", "fr", "t"), (7, "same TEXT here, the very same one #1", "en", "u"), (8, "one two", "en", "u"), (9, "ONE\ttwo", "en", "t"), (9, "other words of one id", "en", "t"),
]
CLASHING = ("node", "label", "g", "n", "id", "term", "block", "seat", "value", "part", "step", "fails", "first", "h1", "h2", "_text", "_words", "good", "quality", "token", "rank")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).select("*", *(F.lit(1).alias(c) for c in CLASHING)).repartition(3)


# --- op11 ---
def shingle_set(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def jaccard_brute(rows, percent=85):
    """(id, set size, least id of the component) of each row; None counts as the greatest id."""
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(float("inf") if k is None else k)
    first = [min(least[find(i)]) for i in range(len(rows))]
    return Counter((k, len(s), None if f == float("inf") else f) for (k, _), s, f in zip(rows, sets, first, strict=True))


def near_copies(seed):
    """Texts around several templates with edits about the threshold, chains of drifting copies, and a passage that many hold."""
    rng, rows = random.Random(seed), []
    word = lambda: "w%d" % rng.randrange(4000)
    passage = [word() for _ in range(30)]
    for size in (5, 9, 40, 120, 300):
        base = [word() for _ in range(size)]
        for k in range(14):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, size // 20))):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text).upper() if k % 5 == 0 else " ".join(text))
        drift = list(base)
        for _ in range(10):
            drift[rng.randrange(len(drift))] = word()
            rows.append(" ".join(drift))
    for _ in range(60):
        own = [word() for _ in range(rng.randrange(5, 120))]
        rows.append(" ".join(own + passage))
    rows += ["x", "x y", "X y", "x y z", "", " ", "x y z w", "x y z w x y z w"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def found_components(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_against_brute_force(spark, seed):
    from tickloom.llm.group_join import jaccard_components

    rows = near_copies(seed)
    assert found_components(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == jaccard_brute(rows)


@pytest.mark.parametrize("percent", [50, 100])
def test_jaccard_components_at_other_thresholds(spark, percent):
    from tickloom.llm.group_join import jaccard_components

    rows = near_copies(3)
    assert found_components(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)) == jaccard_brute(rows, percent)


def test_jaccard_components_of_odd_rows(spark, odd):
    from tickloom.llm.group_join import jaccard_components

    assert found_components(jaccard_components(odd)) == jaccard_brute([(r[0], r[1]) for r in ODD])
    assert jaccard_components(odd.limit(0)).count() == 0


def test_jaccard_components_do_not_depend_on_the_rounds(spark, monkeypatch):
    from tickloom.llm import group_join

    rows = near_copies(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(group_join, "ROUNDS", 0)
    assert found_components(group_join.jaccard_components(docs)) == jaccard_brute(rows)


@pytest.mark.parametrize(("percent", "many", "tries"), [(85, 1, 4), (85, 2, 0), (50, 1, 1), (100, 1, 1)])
def test_jaccard_components_do_not_depend_on_what_is_a_crowd(spark, monkeypatch, percent, many, tries):
    from tickloom.llm import group_join

    rows = [(k, t) for k, t in near_copies(5)] + [(10_000 + k, t) for k, t in crowd(60, 6)]
    for name, value in {"MANY": many, "TRIES": tries, "ROUNDS": tries % 2}.items():
        monkeypatch.setattr(group_join, name, value)
    assert found_components(group_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)) == jaccard_brute(rows, percent)


def crowd(n, seed):
    """Texts of one template, two or three words of each changed to some of its own or one of a few, or left out, so that most similarities are just
    under or over 0.85; and families that share three changes."""
    rng, rows = random.Random(seed), []
    base = [f"b{k}" for k in range(147)]
    families = [{rng.randrange(147): f"f{k}{i}" for i in range(3)} for k in range(3)]
    for k in range(n):
        text = dict(enumerate(base)) | (families[k % 3] if k % 8 == 0 else {})
        for at in rng.sample(range(147), 1 if k % 8 == 0 else rng.choice([2, 3])):
            text[at] = rng.choice([f"own{k} own{k}x", f"own{k}", f"few{rng.randrange(3)}", "", "", f"own{k}y"])
        rows.append(" ".join(w for _, w in sorted(text.items()) if w))
    return list(enumerate(rows))


def test_jaccard_components_of_a_crowd_make_few_pairs(spark, monkeypatch):
    """Twice the texts of one template: about twice the pairs, not four times."""
    from tickloom.llm import group_join

    checked, plain = [], group_join.linked

    def linked(pairs, *rest, **named):
        checked.append(pairs.count())
        return plain(pairs, *rest, **named)

    monkeypatch.setattr(group_join, "linked", linked)
    made = []
    for n in (200, 400):
        checked.clear()
        rows = crowd(n, 7)
        assert found_components(group_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == jaccard_brute(rows)
        made.append(sum(checked))
    assert made[1] < 3 * made[0] and made[1] < 10 * 400, made


def test_first_tokens_of_linked_sets_meet():
    """The bound that everything rests on, over all small sets that link."""
    from tickloom.llm.group_join import least_common, spare

    first = lambda n, p: n - least_common(n, p) + spare(n)
    for p in (50, 85, 100):
        for n in range(1, 60):
            assert 1 <= first(n, p) <= n
            for m in range(n, 60):
                for common in range(n + 1):
                    if 100 * common < p * (n + m - common):
                        continue
                    # the worst case: what only one set has comes first
                    own_n, own_m = n - common, m - common
                    both = min(first(n, p) - own_n, first(m, p) - own_m, common)
                    assert both >= spare(n) >= spare(least_common(m, p)) and n >= least_common(m, p)


# --- op12 ---
def divergence_brute(rows, top=200, min_docs=3):
    groups, docs, out = defaultdict(Counter), defaultdict(Counter), []
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    for lang in {k for k, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        of = {s: c for (k, s), c in groups.items() if k == lang}
        whole = sum(of.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: shares(c) for s, c in of.items()}, shares(whole)
        for s in of:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in of if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)]
    return Counter(out)


def found_divergence(df):
    return Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def talk(seed, n=300):
    rng, rows = random.Random(seed), []
    terms = [f"{rng.choice('abcdéü')}{'xyz'[k % 3]}{'q' * (k // 3 % 7)}{'j' * (k // 21)}" for k in range(150)]
    for k in range(n):
        source = f"s{min(rng.randrange(20), rng.randrange(20))}"
        words = [terms[min(rng.randrange(150), rng.randrange(150))] for _ in range(rng.randrange(0, 40))]
        rows.append((k, " 7,".join(words) + " Only%d" % k, "en" if k % 3 else rng.choice(["de", "fr"]), source))
    return rows


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_divergence_against_brute_force(spark, block):
    from tickloom.llm.divergence import source_divergence

    rows = talk(5)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert found_divergence(source_divergence(docs, block=block)) == divergence_brute(rows)
    assert found_divergence(source_divergence(docs, block=block, top=3)) == divergence_brute(rows, top=3)


def test_divergence_of_odd_rows(spark, odd):
    from tickloom.llm.divergence import source_divergence

    assert found_divergence(source_divergence(odd)) == divergence_brute(ODD)
    assert found_divergence(source_divergence(odd, min_docs=1)) == divergence_brute(ODD, min_docs=1)
    assert source_divergence(odd.limit(0)).count() == 0


def test_terms_whose_hashes_collide_are_told_apart(spark, monkeypatch):
    """Every hash the same: one term in each batch is a run's first, all others are counted by themselves."""
    import numpy as np
    import pyarrow as pa

    from tickloom.llm import divergence

    monkeypatch.setattr(divergence, "span_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    rows = talk(7, 40)
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in (2, 3, 1)], names=["lang", "source", "text"])
    found, want = Counter(), Counter()
    for r in divergence._counted(batch).to_pylist():
        found[r["lang"], r["source"], r["term"]] += r["n"] + 1000 * r["n_docs"]
    for _, text, lang, source in rows:
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower()))
        want.update({(lang, source, t): n + 1000 for t, n in terms.items()})
    assert found == want


def test_shares_are_exact():
    import numpy as np

    from tickloom.llm.divergence import distance, share_of_unit

    rng = random.Random(6)
    for total in (3, 1000, (1 << 53) - 1, (1 << 53) + 5, (1 << 59) - 1):
        n = [0, total - 1, *(rng.randrange(total) for _ in range(50))]
        p = share_of_unit(np.array(n), total).tolist()
        assert p == [1 + 10**9 * (x + 1) // total for x in n]
        q = p[::-1]
        assert distance(np.array(p), np.array(q)).tolist() == [(a - b) ** 2 // b for a, b in zip(p, q, strict=True)]
    with pytest.raises(ValueError):
        share_of_unit(np.array([1]), 1 << 59)


def test_every_two_seats_meet_once(spark):
    from tickloom.llm.divergence import partner

    for seats in (2, 4, 8):
        turns = spark.range(seats).select(F.col("id").cast("int").alias("s"), *(partner(F.col("id").cast("int"), t, seats).alias(f"t{t}") for t in range(seats - 1))).collect()
        met = Counter(frozenset((r.s, r[f"t{t}"])) for r in turns for t in range(seats - 1))
        assert set(met.values()) == {2} and len(met) == seats * (seats - 1) // 2


# --- op13 ---
def audit_brute(rows, labels):
    good, toxic = ({k for k, *x in labels if x[j] == 1 and k is not None} for j in (0, 1))
    key = lambda k: float("inf") if k is None else k
    least = {}
    for k, text, *_ in rows:
        least[text or ""] = min(least.get(text or "", float("inf")), key(k))
    flags = []
    for k, text, _, source in rows:
        t, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": key(k) > least[t]}
        flags.append((source or "", {f for f, x in fails.items() if x}, k in good, k in toxic))
    counts = {}
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone, stay = [f for f in left if letter in f[1]], [f for f in left if letter not in f[1]]
                shapley[letter] += len(gone)
                failing = [f for f in own if letter in f[1]]
                counts[part, "".join(order), step] = [len(stay), len(gone), len(failing) - len(gone), sum(f[1] == {letter} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                left = stay
        for (p, order, step), c in counts.items():
            if p == part:
                c.append(shapley[order[step - 1]])
    return {(*k, *c) for k, c in counts.items()}


LABELS = [(1, 1, 0), (3, 1, None), (3, 0, 1), (3, 1, 1), (4, None, 1), (6, 0, 0), (7, 1, 0), (None, 1, 1), (99, 1, 1)]


def test_filter_audit_against_brute_force(spark, odd):
    from tickloom.llm.filter_audit import COUNTS, filter_interactions

    rng = random.Random(8)
    rows = [*ODD]
    for k in range(20, 140):
        words = [rng.choice(["The", "quick", "FOX", "ran", "at", "$5", "over%d" % rng.randrange(400)]) if rng.random() < 0.4 else "t%d" % rng.randrange(999) for _ in range(rng.randrange(10, 120))]
        rows.append((k, rng.choice([" ".join(words), "copy " * 60, rows[-1][1]]), "en", f"s{k % 3}"))
    labels = spark.createDataFrame([*LABELS, *((k, k % 2, int(k % 7 == 0)) for k in range(20, 140, 3))], "doc_id long, quality int, toxic int").withColumn("part", F.lit(2))
    docs = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(1).alias(c) for c in CLASHING)).repartition(4)
    out = filter_interactions(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step, *(r[c] for c in COUNTS), r.shapley) for r in out}
    assert len(found) == len(out) and found == audit_brute(rows, [tuple(r)[:3] for r in labels.collect()])


def test_filter_audit_of_empty_tables(spark, odd):
    from tickloom.llm.filter_audit import filter_interactions, orders

    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_interactions(odd.limit(0), labels).count() == 0
    assert filter_interactions(odd, labels.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0
    with pytest.raises(ValueError):
        orders(spark, "AAB")
