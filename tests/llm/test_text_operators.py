"""Line dedup, language ID, decontamination, quality and the n-gram join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwitness.llm import decontam, langid, linededup, ngramjoin, quality

from .conftest import prose

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- lines


def brute_lines(rows):
    key = lambda line: line.strip(SPACES).translate(LOWER)
    held = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        known = lambda k: {x for x in held[k] if x is not None}
        kept = [x for x in lines if len(key(x)) < 20 or len(known(key(x))) < 3 or max(known(key(x))) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_lines(docs, awkward):
    got = linededup.dedup_lines(docs).select("doc_id", "__ld_n_lines", "__ld_n_dropped", "__ld_sha256").collect()
    assert Counter(map(tuple, got)) == brute_lines(awkward)


def test_lines_keep_other_columns(spark, docs, no_docs):
    odd = docs.select("doc_id", "text", F.lit(1).alias("pos"), F.lit("x").alias("hash"), F.lit(2).alias("drop"))
    out = linededup.dedup_lines(odd)
    assert out.columns[:5] == odd.columns and out.where("pos = 1 AND hash = 'x' AND drop = 2").count() == odd.count()
    assert linededup.dedup_lines(no_docs).count() == 0


# ---- language


def brute_language(texts, labelled):
    def grams(text):
        c = " " + re.sub(r"\s+", " ", "".join(ch.lower() if ch.isalpha() and len(ch.lower()) == 1 else ch if ch.isalpha() else " " for ch in text)).strip() + " "
        if not c.strip():
            return Counter()
        out = Counter()
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                g = c[i : i + n]
                if n > 1 or g != " ":
                    out[g] += 1
        return out

    def code(g):
        v = [0 if ch == " " else ord(ch) for ch in g] + [langid._NONE] * (3 - len(g))
        return (v[0] << 42) | (v[1] << 21) | v[2]

    rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[: langid.PROFILE]]
    counts = defaultdict(Counter)
    for text, lang in labelled:
        if text and lang:
            counts[lang].update(grams(text))
    profiles = {k: {g: i for i, g in enumerate(rank(c))} for k, c in sorted(counts.items()) if c}
    out = []
    for text in texts:
        own = rank(grams(text or ""))
        if not own or not profiles:
            out.append("und")
        else:
            away = {k: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for k, p in profiles.items()}
            out.append(min(away, key=lambda k: (away[k], k)))
    return out


def test_language(docs, awkward, no_docs):
    learned = langid.profiles(docs)
    got = [tuple(r) for r in langid.identify(docs, learned).select("text", "__li_lang", "__li_score").collect()]
    expected = brute_language([g[0] for g in got], [(r[1], r[2]) for r in awkward])
    assert [g[1] for g in got] == expected
    assert all(0 <= g[2] <= 1 for g in got) and {g[1] for g in got if not (g[0] or "").strip() or g[0] == "123 456 !!"} == {"und"}
    many = {f"{k}-{c}": v for c in range(70) for k, v in learned.items()}  # several blocks of languages, the first by name wins
    assert [r[0] for r in langid.identify(docs, many).select("__li_lang").collect()] == [g if g == "und" else f"{g}-0" for g in expected]
    assert langid.profiles(no_docs) == {} and {r[0] for r in langid.identify(docs, {}).select("__li_lang").collect()} == {"und"}


def test_language_held_out(spark):
    rng = random.Random(3)
    rows = [(prose(rng, lang, 60), lang) for lang in ("en", "fr", "de") for _ in range(40)]
    learned = langid.profiles(spark.createDataFrame(rows[::2], "text string, lang string"))
    got = langid.identify(spark.createDataFrame(rows[1::2], "text string, lang string"), learned)
    assert got.where("lang = __li_lang").count() >= 0.95 * got.count()


# ---- decontamination


def test_decontamination(spark, no_docs, monkeypatch):
    rng = random.Random(11)
    items = [(k, f"A train leaves {name} at {h} km/h and travels {h * 3} miles with {prose(rng, 'en', 14)} How far is {name} after {k + 2} hours?") for k, (name, h) in enumerate([("Boston", 40), ("Madrid", 55), ("Oslo", 70)])]
    items += [(7, items[0][1]), (8, None), (9, ""), (10, "short one here")]
    items += [(11, "let Anna see Bob then Anna asks Bob while Anna meets Bob near Anna today")]
    plain = "so let {} see {} then {} asks {} while {} meets {} near {} today"
    other = items[1][1].replace("Madrid", "Turin").replace("55 km", "81 km").replace("165 miles", "243 miles")
    torn = items[2][1].replace("Oslo at", "Lima at")  # one name, two values
    rows = [
        (1, "so " + items[0][1] + " and more", "as it is"), (2, other, "re-parameterised"), (3, prose(rng, "en", 200), None), (4, torn.replace("70 km", "71 km"), "re-parameterised"),
        (8, plain.format("Carl", "Dora", "Carl", "Dora", "Carl", "Dora", "Carl"), "re-parameterised"), (9, plain.format("Carl", "Dora", "Eve", "Fay", "Gus", "Hal", "Ian"), None),
        (5, None, None), (6, "", None), (7, f"{prose(rng, 'en', 3000)} {items[1][1]} {prose(rng, 'en', 3000)}", "as it is"), (None, items[0][1], "as it is"), (1, "so " + items[0][1] + " and more", "as it is"),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").withColumn("hash", F.lit(1))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (decontam.MOST_BITS, 6):  # a filter that tells windows apart, and one that lets all through
        monkeypatch.setattr(decontam, "LEAST_BITS", min(10, most))
        monkeypatch.setattr(decontam, "MOST_BITS", most)
        got = {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(docs, bench).collect()}
        assert got == {(1, 0): "as it is", (2, 1): "re-parameterised", (7, 1): "as it is", (None, 0): "as it is", (4, 2): "re-parameterised", (8, 11): "re-parameterised"}
    assert decontam.contaminated(no_docs, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_items_with_equal_templates(spark):
    """Items that differ in numbers and names only are different items, each with its own values."""
    text = "once {} saw {} ships and then {} more came over to the shore where {} people with {} flags stood and sang until the sun was down and nobody there could see {} boats any more that night"
    a, b = text.format("Ann", 3, 4, 5, 6, 7), text.format("Bob", 13, 14, 15, 16, 17)
    items = spark.createDataFrame([(1, a), (2, b)], "item_id bigint, text string")
    part = " ".join(b.split()[:15])  # 11 of 31 windows, all with b's values
    docs = spark.createDataFrame([(1, f"so {b} indeed"), (2, f"so {part} something else follows"), (3, f"so {a} indeed")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 1): "re-parameterised", (1, 2): "as it is", (2, 2): "as it is", (3, 1): "as it is", (3, 2): "re-parameterised"}


def test_decontamination_of_names_that_begin_sentences(spark):
    text = "{0} has {2} apples. {1} has {3} apples. {0} gives {1} {4} apples. How many apples does {0} have?"
    items = spark.createDataFrame([(1, text.format("Tom", "Ann", 3, 5, 2)), (2, "Oslo")], "item_id bigint, text string")
    torn = "Bob has 4 apples. Eve has 7 apples. Carl gives Dora 6 apples. How many apples does Fay have?"  # each name has two values
    docs = spark.createDataFrame([(1, text.format("Bob", "Eve", 4, 7, 6)), (2, text.format("Tom", "Ann", 3, 5, 2)), (3, torn), (4, "Well, " + text.format("Bob", "Eve", 4, 7, 6))], "doc_id bigint, text string")
    got = {r.doc_id: (r.kind, r.matched_windows, r.item_windows) for r in decontam.contaminated(docs, items).collect()}
    assert got == {1: ("re-parameterised", 15, 15), 2: ("as it is", 15, 15), 4: ("re-parameterised", 15, 15)}


def test_decontamination_of_repeated_and_null_items(spark):
    """Copies of an item and different texts under one id don't raise what must be met; null ids are reported."""
    a = "seven sisters walk beside the river every evening singing"
    b = "a merchant sold {} carpets to {} farmers before the market closed at dusk"
    rows = [(1, "short item here")] * 2 + [(2, a)] * 4 + [(3, b.format(5, 6))] * 3 + [(4, "the quick fox jumps over some lazy dogs"), (4, "five boxing wizards jump quickly over the tall fence by the road at night while it rains"), (None, "nobody knows who wrote this line about winter")]
    items = spark.createDataFrame(rows, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "so short item here now"), (2, f"so {a} now"), (3, f"so {b.format(8, 9)} now"), (4, "see the quick fox jumps over some lazy dogs now"), (5, "but nobody knows who wrote this line about winter now")], "doc_id bigint, text string")
    got = [(r.doc_id, r.item_id, r.kind, r.matched_windows == r.item_windows) for r in decontam.contaminated(docs, items).collect()]
    assert sorted(got) == [(1, 1, "as it is", True), (2, 2, "as it is", True), (3, 3, "re-parameterised", True), (4, 4, "as it is", True), (5, None, "as it is", True)]


def brute_template(text):
    """Tokens of a template one by one: ("w", word), ("slot", kind, value), or ("opener", word)."""
    out, begins, after_number = [], True, False
    for raw in (text or "").split():
        core = re.sub(r"^[\W_]+|[\W_]+$", "", raw)
        percent = raw.rstrip(".,;:!?)").endswith("%")
        ends = raw.rstrip("\"')]»”").endswith((".", "!", "?", ":"))
        joined = re.match(r"^([+-]?[\d.,]*\d)([^\W\d_]+|%)$", core)
        number = re.match(r"^[+-]?[\d.,:/]*\d[\d.,:/]*$", core)
        skip = False
        if not core and not percent:
            skip = True
        elif not core or core.lower() in decontam.UNITS:
            out.append(("slot", "unit", core.lower() or "%") if after_number else ("w", core.lower()))
            after_number = False
        elif joined or (percent and number):
            out += [("slot", "num", joined[1].lower() if joined else core), ("slot", "unit", joined[2].lower() if joined else "%")]
            after_number = False
        elif number:
            out.append(("slot", "num", core.lower()))
            after_number = True
        elif core[0].isupper():
            out.append(("opener" if begins else "slot", *(() if begins else ("name",)), core.lower()))
            after_number = False
        else:
            out.append(("w", core.lower()))
            after_number = False
        begins = ends or (begins and skip)
    return out


def brute_contaminated(docs, items, width=5, min_share=0.5, min_windows=9, min_run=3):
    """(doc_id, item_id, kind, matched, item's windows): every alignment of every document and item, one by one."""

    def windows(tokens, w, names):
        out = {}
        for i in range(len(tokens) - w + 1):
            own = [("slot", "name", t[1]) if names and t[0] == "opener" else t for t in tokens[i : i + w]]
            if all(t[0] == "slot" for t in own):
                continue
            out[i] = tuple(t[:2] if t[0] == "slot" else ("w", t[1]) for t in own), [t[1:] for t in own if t[0] == "slot"], any(t[0] == "opener" for t in tokens[i : i + w])
        return out

    unique = {}
    for i, text in items:
        t = tuple(brute_template(text))
        if t:
            unique[t] = i if t not in unique or unique[t] is None else min(unique[t], i if i is not None else unique[t])
    found = set()
    for doc_id, text in docs:
        tokens = brute_template(text)
        for item, item_id in unique.items():
            w = min(width, len(item))
            n_windows = len({p for names in (False, True) for p in windows(list(item), w, names)})
            covered, same, best = set(), set(), []
            if not n_windows:
                continue
            for shift in range(-len(item), len(tokens)):
                here, clean, kinds = set(), set(), []
                for names in (False, True):
                    a, b = windows(list(item), w, names), windows(tokens, w, names)
                    # a window that only one side has in this reading is met in the other side's
                    at = [p for p in a if p + shift in b and a[p][0] == b[p + shift][0]]
                    values = defaultdict(set)
                    for p in at:
                        for x, y in zip(a[p][1], b[p + shift][1], strict=True):
                            values[x].add(y[1])
                    fit = {p for p in at if all(len(values[x]) == 1 for x in a[p][1])}
                    if len(fit) >= min(min_run, n_windows):
                        here |= fit
                        clean |= {p for p in fit if all(values[x] == {x[1]} for x in a[p][1])}
                        kinds.append((len(fit), -sum(any(v != x[1] for v in vs) for x, vs in values.items())))
                if here:
                    covered |= here
                    same |= clean
                    best.append(-max(kinds)[1])
            if len(covered) >= min_share * n_windows or len(same) >= min_windows:
                found.add((doc_id, item_id, "re-parameterised" if min(best) else "as it is", len(covered), n_windows))
    return found


def test_decontamination_against_every_alignment(spark):
    rng = random.Random(21)
    names, nouns = ["Tom", "Ann", "Bob", "Eve", "Lima", "Oslo"], "apples boats stones birds coins".split()

    def story(own, numbers, thing):
        a, b = own
        return rng.choice([
            f"{a} has {numbers[0]} {thing}. {b} has {numbers[1]} {thing}, and {a} gives {b} {numbers[2]} of them. How many does {a} have?",
            f"A train leaves {a} at {numbers[0]} km/h and reaches {b} after {numbers[1]}kg of coal; 5% of it was lost near {a}.",
            f"once {numbers[0]} {thing} were sold to {b} and {a} for {numbers[1]} dollars each, all {numbers[2]} people saw",
        ])

    pick = lambda: (rng.sample(names, 2), [str(rng.randint(2, 9)) for _ in range(3)], rng.choice(nouns))
    items = [(i, story(*pick())) for i in range(8)] + [(50, "just two"), (51, "12 13"), (52, "Oslo"), (53, None), (None, "nobody knows this one")]
    docs = []
    for i in range(40):
        parts = [prose(rng, "en", rng.randint(0, 12)) for _ in range(2)]
        body = rng.choice([story(*pick()), rng.choice(items)[1] or "", "", "12 13 14 15 16 17 18", "see just two of nobody knows this one"])
        if rng.random() < 0.3 and body:
            words = body.split()
            words[rng.randrange(len(words))] = rng.choice([*names, "7", "other"])
            body = " ".join(words)
        docs.append((i, f"{parts[0]}. {body} {parts[1]}"))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id, r.kind, r.matched_windows, r.item_windows) for r in got.collect()} == brute_contaminated(docs, items)


def test_templates_one_by_one():
    rng = random.Random(5)
    pieces = ["Tom", "the", "12", "3.5", "5kg", "7%", "%", "km", "—", "(", "end.", "Ann!", "\"Bob\"", "x.", "::", "12:30", "dollars", "Ünder", "é1", "+4", "10m.", "a_b", "_"]
    for _ in range(500):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        t = decontam.Template(text)
        opens = set(t.openers.tolist())
        got = [("opener", t.value(k)[1]) if k in opens else ("slot", *t.value(k)) if t.slot[k] else None for k in range(len(t.hashes))]
        assert got == [x if x[0] != "w" else None for x in brute_template(text)], text


def test_tables_of_numbers_are_no_evidence(spark):
    """Unrelated lists of numbers or names meet in all places and say nothing."""
    rng = random.Random(1)
    numbers = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    docs = spark.createDataFrame([(1, numbers(4_000)), (2, "Total " + numbers(20)), (3, " ".join(["Ann Bob Eve"] * 500))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, numbers(400)), (2, "Tom Ann Lima Oslo Bob Eve Tom Bob")], "item_id bigint, text string")
    assert decontam.contaminated(docs, items).count() == 0


# ---- quality


def brute_quality(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines, dups = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(SPACES):
            dups += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def test_quality(spark, docs, awkward, no_docs):
    rng = random.Random(14)
    extra = [(300, "a b c d e f a b c d e f # * dup\ndup\ndup\n  \n", "en", "src0"), (301, "x " * 50, "en", "src0")]
    line = prose(rng, "en", 12)
    once, often = (f"{prose(rng, 'en', 900)}\n{(line + chr(10)) * n}{prose(rng, 'en', 900)}" for n in (2, 15))
    extra += [(302, once, "en", "src0"), (303, often, "en", "src0")]
    both = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumns({"kept": F.lit(3), "n_words": F.lit(1)})
    stats = quality.measured(both)
    got = Counter(tuple(r) for r in stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((r[0], *brute_quality(r[1])) for r in [*awkward, *extra])
    judged = quality.judged(stats)
    kept = {r.doc_id: (r.base_failed, r.kept) for r in judged.where("doc_id IN (302, 303)").collect()}
    assert kept == {302: (False, True), 303: (False, False)}  # one repeated line is spared, many are more than the group has
    assert judged.count() == len(awkward) + 4 and judged.where("kept AND base_failed").count() == 0 and judged.where("kept").count() > 50
    assert quality.judged(quality.measured(no_docs)).count() == 0


def test_quantile_sketch_merges(spark):
    rng = random.Random(5)
    values = [rng.randint(0, 10 ** rng.randint(1, 6)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    edges = {r.v: (r.b, r.e) for r in df.select("v", F.expr(quality.bucket_sql("v")).alias("b")).select("v", "b", F.expr(quality.low_edge_sql("b")).alias("e")).collect()}
    assert all(e <= v <= e * (1 + 1 / 64) + 1 for v, (_, e) in edges.items())
    order = sorted(edges)
    assert all(edges[a][0] <= edges[b][0] for a, b in zip(order, order[1:], strict=False))


# ---- n-gram join


def brute_groups(rows, width, percent):
    sets = []
    for i, text, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * o >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[find(k)].append(r[0])
    return Counter((r[0], len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, r in enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_similar_groups(docs, awkward, no_docs, width, percent):
    got = Counter(tuple(r) for r in ngramjoin.similar_groups(docs, width=width, percent=percent).collect())
    assert got == brute_groups(awkward, width, percent)
    if width == 4:
        assert ngramjoin.similar_groups(no_docs).count() == 0


def test_similar_groups_of_many_sizes(spark, monkeypatch):
    """Small sets, chains of links and groups larger than a tree, through all rounds."""
    monkeypatch.setattr(ngramjoin, "TREE", 4)
    monkeypatch.setattr(ngramjoin, "SKETCHES", 4)
    monkeypatch.setattr(ngramjoin, "TREE_BYTES", 700)
    monkeypatch.setattr(ngramjoin, "SKETCH_BYTES", 60)
    rng = random.Random(2)
    rows = []
    for size in (3, 6, 8, 9, 12, 13, 20, 40, 90):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            rows.append((len(rows), " ".join(base), ""))
            base = list(base)
            at = rng.randrange(len(base))
            base[at : at + rng.randrange(2)] = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(2))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    for width, percent in ((4, 85), (1, 60)):
        assert Counter(map(tuple, ngramjoin.similar_groups(docs, width=width, percent=percent).collect())) == brute_groups(rows, width, percent)


def test_sets_that_share_a_key_are_hashed_anew(spark, monkeypatch):
    real, seeds = ngramjoin.set_key, []

    def poor(grams, seed=0):
        seeds.append(seed)
        key, other = real(grams, seed)
        return (key % 2, other) if seed == 0 else (key, other)

    rows = [(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(6)]
    rows.append((9, rows[0][1]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    source = docs.select("doc_id", "text").toArrow().to_batches()
    monkeypatch.setattr(ngramjoin, "set_key", poor)
    keys = [k for b in ngramjoin._sets_and_labels(85, 4, 0)(iter(source)) for k in b.column(2).to_pylist()]
    assert len(set(keys)) == 2  # what the check below sees of the first hash
    monkeypatch.setattr(ngramjoin, "_sets_and_labels", lambda percent, width, seed, made=ngramjoin._sets_and_labels: _replayed(made(percent, width, seed), source))
    got = {r.doc_id: r.component_id for r in ngramjoin.similar_groups(docs).collect()}
    assert got == {k: k for k in range(6)} | {9: 0} and {0, 1} <= set(seeds)


def _replayed(run, source):
    """A function for mapInArrow that gives what run makes of source on the driver, where the test has changed it."""
    made = list(run(iter(source)))

    def give(rows):
        if any(b.num_rows for b in rows):
            yield from made

    return give


def test_ngrams_are_kept_of_sets_that_sketches_leave_alone(spark, monkeypatch):
    """Texts that share a passage meet under its labels; n-grams are kept of those alone that may link, and most other texts stay where they are."""
    kept, passed = [], []
    real, real_bloom = ngramjoin.stored, ngramjoin.bloom

    def noting(df, label, path=None):
        made = real(df, label, path)
        if label == "grams":
            kept.append({r.key for r in made.select("key").collect()})
        return made

    def sized(hashes, *bits):
        passed.append(hashes.count())
        return real_bloom(hashes, *bits)

    monkeypatch.setattr(ngramjoin, "stored", noting)
    monkeypatch.setattr(ngramjoin, "bloom", sized, raising=False)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(100)]
    rows = [(k, " ".join(passage + [word() for _ in range(120)])) for k in range(30)]
    rows += [(30, rows[0][1] + " more words here"), (31, rows[0][1])]
    got = Counter(map(tuple, ngramjoin.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == brute_groups(rows, 4, 85)
    assert len(set().union(*kept)) == 2 and passed[0] == 2


def _python_in_a_task(df):
    """The most Python operators that one task of df's plan runs one above the other."""
    most, above = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        name = line.lstrip(" :+-*")
        depth = len(line) - len(name)
        while above and above[-1][0] >= depth:
            above.pop()
        n = above[-1][1] if above else 0
        n = 0 if "Exchange" in name.split(" ")[0] else n + name.startswith(("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython"))
        above.append((depth, n))
        most = max(most, n)
    return most


def test_no_task_has_two_python_workers(spark, monkeypatch):
    """Executors keep all Python workers that they ever had at a time, and what these hold: memory beyond the limit on large tables."""
    found, real = [], ngramjoin.stored

    def noting(df, label, path=None):
        found.append((label, _python_in_a_task(df)))
        return real(df, label, path)

    monkeypatch.setattr(ngramjoin, "stored", noting)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base, *(f"x{k}y{j}" for j in range(k))])) for k in range(4)] + [(None, " ".join(base)), (None, " ".join([*base, "end"])), (2, " ".join(base))]
    got = Counter(map(tuple, ngramjoin.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()))
    assert got == brute_groups(rows, 4, 85)
    assert ("grams", 1) in found and max(n for _, n in found) == 1, found


def test_labels_miss_no_link():
    rng = np.random.default_rng(1)
    for n in (6, 7, 12, 13, 25, 60, 200, 1500):
        for _ in range(60):
            base = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
            drop = int(rng.integers(0, max(1, n // 8) + 1))
            other = np.unique(np.concatenate((base[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, drop + 2)), dtype=np.int64).astype(np.uint64))))
            a = np.unique(base)
            o = len(np.intersect1d(a, other))
            if ngramjoin.linked(o, len(a), len(other), 85) and len(a) * len(other):
                if o != len(a) or o != len(other):
                    assert np.intersect1d(ngramjoin.labels(a, 85), ngramjoin.labels(other, 85)).size
                assert ngramjoin.may_link([ngramjoin.sketch(a)], [ngramjoin.sketch(other)], np.array([len(a)]), np.array([len(other)]), 85).all()


def test_trie_finds_what_comparing_all_finds():
    rng = random.Random(4)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 30))), np.uint64) for _ in range(80)]
    tree = ngramjoin.SetTrie.of([(s, i) for i, s in enumerate(sets)])
    for q in sets:
        for percent in (50, 80):
            assert sorted(tree.links(q, percent)) == [i for i, s in enumerate(sets) if ngramjoin.linked(len(np.intersect1d(q, s)), len(q), len(s), percent)]
