"""Packing, archives, chat trees, the URL filter and the language model: round trips, brute force and held-out data."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import isclose, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwitness.llm import chat_tree, maxent, packing, urlfilter, warc

from .conftest import prose

# ---- packing


def brute_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.TOKENIZER)
    return [*t.encode(text or "", add_special_tokens=False).ids, packing.END]


def test_packing(docs, awkward, no_docs):
    capacity = 512
    got = packing.pack_documents(docs.withColumn("length", F.lit(1)), capacity=capacity).collect()
    expected = Counter()
    for i, text, *_ in awkward:
        ids = np.array(brute_ids(text), "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            expected[i, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in got) // capacity)
    assert len(sequences) <= least + 1
    assert packing.pack_documents(no_docs).count() == 0


def brute_best_fit(counts, capacity):
    """Sequences that best fit by falling length takes, document by document."""
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [g for g in gaps if g >= length]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - length)
            else:
                gaps.append(capacity - length)
    return len(gaps)


def rounds(counts, capacity, ranges):
    """The rounds of packing.plan() on lists."""
    runs, placed, opened = [(packing.DOCUMENT, n, 0, c) for n, c in counts.items() if c], [], 0
    while more := packing.needed([(r[1], r[3]) for r in runs if r[0] == packing.DOCUMENT], sum(r[1] * r[3] for r in runs if r[0] == packing.GAP), capacity):
        runs.append((packing.GAP, capacity, opened, more))
        opened += more
        order = lambda r: (-r[1], r[0], r[2])
        runs.sort(key=order)
        each = -(-len(runs) // ranges)
        for some in ([runs[a : a + each] for a in range(0, len(runs), each)], None):
            out = [x for part in (some or [sorted(runs, key=order)]) for x in packing.sweep(iter(part))]
            placed += [x[1:] for x in out if x[0] == packing.PLACED]
            runs = [x[:4] for x in out if x[0] != packing.PLACED]
    return placed, opened


def checked(placed, counts, capacity):
    """Every rank is placed once and sequences have no holes; the number of sequences."""
    ranks, filled = Counter(), defaultdict(list)
    for length, rank, n, first, side, gap in placed:
        for k in range(n):
            ranks[length, rank + k] += 1
            filled[first + k // side].append((capacity - gap + k % side * length, length))
    assert ranks == Counter({(n, r): 1 for n, c in counts.items() for r in range(c)})
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_rounds_place_every_rank_once_and_no_worse_than_best_fit():
    rng = random.Random(1)
    ours = brute = 0
    for capacity in (7, 64, 1000):
        for trial in range(60):
            counts = {n: rng.randint(0, 50) for n in rng.sample(range(1, (capacity if trial % 2 else max(2, capacity // 3)) + 1), min(capacity // 4 + 1, 20))}
            found = []
            for ranges in (1, 4):
                placed, opened = rounds(counts, capacity, ranges)
                found.append(checked(placed, counts, capacity))
                assert found[-1] == opened
            least = brute_best_fit(counts, capacity)
            assert max(found) <= least + max(1, least // 50)
            ours, brute = ours + found[1], brute + least
    assert ours <= 1.001 * brute


def test_plan_by_tables_is_no_worse_than_best_fit(spark):
    rng = random.Random(2)
    counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, 513), 120)}
    lengths = spark.createDataFrame(list(counts.items()), "length bigint, n bigint")
    placed = [tuple(r)[1:] for r in packing.plan(lengths, 512, ranges=4).collect()]
    assert checked(placed, counts, 512) <= brute_best_fit(counts, 512)
    assert packing.plan(lengths.limit(0), 512).count() == 0


def test_words_are_tokenised_as_whole_texts_are():
    encode = packing.encoder()
    for text in ["it's don't we'll a'b 'S I'M", "a b İstanbul ß ẞ", "x|y <|endoftext|> b", "tab\tnew\nline\r\x0b z", "²¾ 12three 4.5€", "Σας ΟΔΟΣ", "é\u00a0é", "", "\u00ad soft µ ª º ǅ", "x\x1cy", "foo\x85bar", "日本語 テスト 😀"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == brute_ids(text)[:-1]


def test_ids_are_the_tokenizers_for_every_code_point_and_its_own_strings():
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(packing.TOKENIZER), packing.encoder()
    rng = random.Random(3)
    own = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<| endoftext|>", "<|endoftext|", "a<|endoftext|>b"]
    # those that may go word by word each for itself, others many to a text
    one = lambda c: f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1"
    texts = [one(c) for c in range(0x3000)] + [" ".join(one(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0x3000, 0x110000, 256)]
    texts += [" ".join(rng.choice([*own, "word", "Is", "it's", "12", "Ⱥ"]) for _ in range(5)) for _ in range(500)]
    for text, whole in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.ids, text




# ---- archives


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(9)
    bodies = [f"<p>{prose(rng, 'en', 20)}</p>" for _ in range(6)] + ["", None, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "é日本😀", "x" * 300_000]
    rows = [(k, f"http://h{k % 7}.example.com/p?q={k}", rng.choice(bodies)) for k in range(60)]
    rows += [(5, rows[5][1], rows[5][2]), (100, None, bodies[0]), (101, "http://a b\r\nX: y/é%41", bodies[0]), (None, "http://n.example", bodies[1]), (None, None, "alone")]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)


def test_archives(spark, pages):
    rows, df = pages
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    expected = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        f = first.get(html or "")
        revisit = f is not None and f != i
        expected[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", f if revisit else None] += 1
    got = warc.through_archives(df.withColumn("digest", F.lit(1)))
    assert Counter(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == expected
    assert warc.through_archives(df.limit(0)).count() == 0


def test_archives_round_trip_and_rewriting(spark, pages, tmp_path):
    rows, df = pages
    records = df.select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    plain = records.withColumns({"payload": F.coalesce("payload", F.lit("").cast("binary")), "first": F.lit(None).cast("bigint")}).withColumns({"bytes": F.octet_length("payload").cast("bigint"), "digest": warc.base32(F.sha1("payload"))})
    source, target = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    warc.write_archives(plain, source)
    warc.deduplicate(spark, source, target)
    expected = Counter((i, url, (html or "").encode()) for i, url, html in rows)
    for path in (source, target):
        back = warc.with_originals(warc.read_archives(spark, path, payloads=True))
        assert Counter((r.page_id, r.url, bytes(r.payload)) for r in back.collect()) == expected
    assert warc.read_archives(spark, target).where("record_type = 'response'").count() == len({h or "" for _, _, h in rows}) + 1  # page 5 twice
    with pytest.raises(ValueError):
        list(warc.parsed(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"])))


def test_archives_are_unzipped_in_bounded_pieces_and_records_read_alone(spark, pages, tmp_path):
    import gzip

    members = [b"x" * 5_000_000, b"", b"abc" * 1000, b"y" * 70_000]
    data = b"".join(gzip.compress(m) for m in members) + warc.NOTHING
    for step in (1000, 1 << 20):
        got = list(warc._unzipped(data, step))
        assert b"".join(got) == b"".join(members) and max(map(len, got)) <= step
    with pytest.raises(ValueError):
        list(warc._unzipped(data[:-25]))
    assert gzip.decompress(warc.NOTHING) == b"" and list(warc._unzipped(b"")) == []
    _, df = pages
    records = df.select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    warc.write_archives(warc.resolved(records), f"file://{tmp_path}/c", most_bytes=2_000)
    files = list((tmp_path / "c").glob("part-*"))
    assert len(files) > 4
    for file in files:
        body, starts = file.read_bytes(), []
        at = 0
        while at < len(body):  # every member is a record, but for the empty one at the end
            z = zlib.decompressobj(31)
            one = z.decompress(body[at:])
            starts.append(one)
            at = len(body) - len(z.unused_data)
        assert starts[-1] == b"" and all(len(list(warc.parsed(iter([m])))) == 1 for m in starts[:-1])


# ---- chat


def test_escaping_is_reversible():
    rng = random.Random(6)
    for _ in range(3000):
        s = "".join(rng.choice(["\\", "<", "turn>", "/turn>", "</turn>", "<turn>", "\n", "n", "a", "</turn>\n"]) for _ in range(rng.randint(0, 8)))
        assert chat_tree.unescape(chat_tree.escape(s)) == s and chat_tree.unescape_role(chat_tree.escape_role(s)) == s
        assert not re.search(r"</?turn>", chat_tree.escape(s)) and "\n" not in chat_tree.escape_role(s)
        formatted = "".join(f"{chat_tree.OPEN}{chat_tree.escape_role(r)}\n{chat_tree.escape(t)}{chat_tree.CLOSE}" for r, t in [(s, s), ("user", s)])
        assert chat_tree.parse(formatted) == [(s, s), ("user", s)]


def conversations():
    rng = random.Random(8)
    rows = []
    for k in range(80):
        turns = [("system", "be kind")] if k % 2 else []
        while len(turns) < 2 + k % 5:
            turns.append((["user", "assistant"][len(turns) % 2], rng.choice(["hello", "what is </turn> this?", "é😀 \\ <turn>", "", prose(rng, "en", 8)])))
        rows += [(k, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(200, i, *rows[i][2:]) for i in range(2)] + [(201, 0, "assistant", None), (202, 0, None, "x"), (203, 0, "us\ner", "y"), (204, 1, "user", "same"), (204, 1, "user", "same"), (205, None, "user", "first"), (205, 0, "assistant", "z")]
    return rows


def brute_chat(rows):
    held = defaultdict(list)
    for n, (c, turn, role, text) in enumerate(rows):
        held[c if c is not None else f"own{n}"].append((turn is not None, turn or 0, role or "", text or ""))
    out = Counter()
    for c, turns in held.items():
        turns.sort()
        own = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[None if isinstance(c, str) else c, len(turns), own, len(loss), hashlib.sha256(loss.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("max_tokens", [40, 65_536])
def test_chat_trees(spark, max_tokens):
    rows = [*conversations(), (None, 0, "user", "lost"), (None, 0, "assistant", "lost too")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("path", F.lit("p")).repartition(3)
    convs = chat_tree.conversations(df)
    nodes = chat_tree.prefix_trees(convs, max_tokens=max_tokens, ranges=3 if max_tokens < 1000 else None)
    got = chat_tree.read_back(nodes, convs)
    assert Counter(tuple(r) for r in got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()) == brute_chat(rows)
    held = defaultdict(dict)
    for r in nodes.collect():
        held[r.sequence_id][r.node] = r
    once = Counter()
    for own in held.values():
        at = 0
        for k in sorted(own):
            r = own[k]
            assert r.offset == at
            at += len(r.ids)
            way, p = [], r.parent
            while p is not None:
                way.append(own[p])
                p = own[p].parent
            assert r.position_start == sum(len(w.ids) for w in way)
            seen = {i for a in r.attends for i in range(a.start, a.end)}
            assert seen == {i for w in way for i in range(w.offset, w.offset + len(w.ids))}
            assert not r.repeat or r.loss_start == r.loss_end == 0
            once[bytes(r.key)] += not r.repeat
    assert set(once.values()) == {1}  # each turn after the same turns is trained on once, whatever ranges and sequences it is in
    empty = chat_tree.conversations(df.limit(0))
    assert chat_tree.read_back(chat_tree.prefix_trees(empty), empty).count() == 0


def test_shared_turns_bear_their_loss_once(spark):
    turns = [(0, "user", "hello there"), (1, "assistant", "the shared answer")]
    rows = [(c, *t) for c in range(200) for t in [*turns, (2, "user", f"question {c}"), (3, "assistant", f"answer {c} " * 5)]]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    convs = chat_tree.conversations(df)
    code = chat_tree.codec(chat_tree.TOKENIZER)
    for max_tokens in (200, 65_536):
        nodes = chat_tree.prefix_trees(convs, max_tokens=max_tokens, ranges=4)
        under_loss = Counter(code.decode(r.ids[r.loss_start : r.loss_end]) for r in nodes.where("role = 'assistant'").collect())
        assert under_loss.pop("the shared answer") == 1 and under_loss.pop("", 0) == nodes.where("repeat AND role = 'assistant'").count()
        assert under_loss == Counter(f"answer {c} " * 5 for c in range(200))
        assert nodes.where("repeat").count() > 0
        got = Counter(tuple(r) for r in chat_tree.read_back(nodes, convs).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect())
        assert got == brute_chat(rows)


# ---- URLs

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def brute_rule(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fit, key=len, default=None)


def read(url):
    """What the models see of a URL."""
    if url is None or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host) + rest[len(host) :]


def brute_markov(texts, text, at, order=5):
    """log10 of the smoothed probability of a character, with counts taken anew for each context."""
    padded = "\n" * order + text
    at += order
    p = 1 / 0x110000
    for k in range(order + 1):
        context, after = padded[at - k : at], Counter()
        for t in texts:
            own = "\n" * order + t
            for i in range(order, len(own)):
                if own[i - k : i] == context:
                    after[own[i]] += 1
        if not after:
            break
        p = (after[padded[at]] + len(after) * p) / (sum(after.values()) + len(after))
    return log10(p)


def test_many_rules():
    rng = random.Random(3)
    rules = {f"{rng.choice(['', 'a.', 'b.a.'])}h{rng.randrange(300)}.org/{rng.choice(['', 'x', 'x/y', 'z/'])}": rng.choice(["allow", "block"]) for _ in range(2_000)}
    found = urlfilter.Rules(rules)
    for _ in range(2_000):
        host, path = f"{rng.choice(['', 'a.', 'b.a.', 'c.b.a.', '.'])}h{rng.randrange(300)}.org", rng.choice(["", "/", "/x", "/x/y/z", "/z/"])
        fit = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        assert found.find(host, path) == min(fit, key=lambda r: (-len(r), r), default=None)


def test_url_filter(spark):
    rng = random.Random(4)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'A.'])}{rng.choice(['example', 'other', 'fourth'])}.{rng.choice(['net', 'com', 'org', 'NET'])}/{rng.choice(['en', 'de', 'fr', ''])}/{rng.randrange(1000)}" for _ in range(120)]
    urls += [None, "", "nothing", "www.example.net/de/5", "http://net", "http://net/", "http://x.net?y://z/", "a://b://c/d", "http://example.net/en/?q#f", "http://É.NET/", "x" * 100_000 + "://h.org/fr/", "http://org/fr/\nnext"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("mine"))
    got = {r.page_id: r for r in urlfilter.judge(df, RULES).collect()}
    for i, url in enumerate(urls):
        host, path, rule = brute_rule(url)
        assert (got[i]["__uf_host"], got[i]["__uf_path"], got[i]["__uf_rule"]) == (host, path, rule)
        assert got[i]["__uf_verdict"] == (RULES[rule] if rule else got[i]["__uf_verdict"]) and got[i].host == "mine"
    # the verdicts of all others, by models learned and scored one character after the other
    split = defaultdict(list)
    labelled = {(read(url), RULES[got[i]["__uf_rule"]]) for i, url in enumerate(urls) if got[i]["__uf_rule"]}
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t, _ in labelled], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    for t, verdict in labelled:
        if len(t) <= 2_000:
            split[verdict, hashes[t] % 5 == 0].append(t)
    brute = lambda t: (sum(brute_markov(split["allow", False], t, k) - brute_markov(split["block", False], t, k) for k in range(len(t))) / len(t)) if t else 0.0
    least = urlfilter.threshold([brute(t) for t in split["allow", True]], [brute(t) for t in split["block", True]])
    some = [i for i, url in enumerate(urls) if not got[i]["__uf_rule"] and len(url or "") < 1000][-40:]
    assert sum(1 for i in some if urls[i] and "://" not in urls[i]) >= 2
    for i in some:
        score = brute(read(urls[i]))
        assert isclose(got[i]["__uf_score"], score, rel_tol=1e-9, abs_tol=1e-12) and got[i]["__uf_verdict"] == ("block" if score < least else "allow")
    assert urlfilter.judge(df.limit(0), RULES).count() == 0
    assert {r["__uf_verdict"] for r in urlfilter.judge(df, {}).collect()} == {"allow"}


def test_markov_models():
    model = urlfilter.Markov(["abab", "abac"], 2)
    assert isclose(sum(10 ** model.log10("ab", c) for c in "abc\n") + 10 ** model.log10("ab", "q") * (0x110000 - 4), 1, rel_tol=1e-9)
    rng = random.Random(2)
    good = [f"site/{rng.choice(['news', 'wiki', 'doc'])}/{rng.randrange(10**5)}" for _ in range(400)]
    bad = [f"site/{rng.choice(['casino', 'pills', 'xxx'])}/{rng.randrange(10**5)}" for _ in range(400)]
    ratio = urlfilter.Ratio(good[:200], bad[:200], 5)
    least = urlfilter.threshold([ratio.score(t) for t in good[200:300]], [ratio.score(t) for t in bad[200:300]])
    assert np.mean([ratio.score(t) >= least for t in good[300:]]) > 0.97 and np.mean([ratio.score(t) < least for t in bad[300:]]) > 0.97


# ---- language model


def lm_tokens(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(lower)), None]


def test_language_model(spark, docs, awkward, no_docs):
    clash = {c: F.lit("mine") for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "share", "token", "c", "pair")}
    own = docs.select("doc_id", "text", (F.coalesce(F.col("doc_id") % 5 != 2, F.lit(False))).alias("learn")).withColumns(clash)
    scored = maxent.score(own)
    assert scored.columns[: len(clash) + 2] == ["doc_id", "learn", *clash] and scored.where(" AND ".join(f"{c} = 'mine'" for c in clash)).count() == len(awkward)
    got = scored.collect()
    counts = Counter(x for i, t, *_ in awkward if i is not None and i % 5 != 2 for x in lm_tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = defaultdict(list)
    for i, t, *_ in awkward:
        own_tokens = lm_tokens(t)
        expected[i].append((len(own_tokens), sum(counts[x] > 0 for x in own_tokens), sum(log10((counts[x] + 1) / (n + v + 1)) for x in own_tokens)))
    for r in got:
        assert r["__lm_train_tokens"] == n
        assert any((r["__lm_n_tokens"], r["__lm_n_known"]) == e[:2] and isclose(r["__lm_base_score"], e[2], rel_tol=1e-9) for e in expected[r.doc_id])
    long = [r for r in got if r["__lm_n_tokens"] > 50 and (r.doc_id or 0) % 5 == 2]
    assert sum(r["__lm_score"] for r in long) > 0.9 * sum(r["__lm_base_score"] for r in long)  # on documents not learned from
    assert maxent.score(no_docs.select("doc_id", "text", F.lit(True).alias("learn"))).count() == 0
    assert all(r["__lm_n_known"] == 0 and np.isfinite(r["__lm_score"]) for r in maxent.score(docs.select("doc_id", "text", F.lit(False).alias("learn"))).collect())


def test_language_model_does_not_depend_on_how_the_table_is_split(spark, docs):
    own = docs.select("doc_id", "text", (F.coalesce(F.col("doc_id") % 5 != 2, F.lit(False))).alias("learn"))
    found = []
    for parts in (1, 4, 16):
        rows = maxent.score(own.repartition(parts)).select("doc_id", "__lm_n_tokens", "__lm_score").collect()
        found.append(sorted((r.doc_id is None, r.doc_id or 0, r[1], r[2]) for r in rows))
    for other in found[1:]:
        assert all(a[:3] == b[:3] and isclose(a[3], b[3], rel_tol=1e-6, abs_tol=1e-6) for a, b in zip(found[0], other, strict=True))


def brute_forward(model, words_seen, counts, text, at):
    """The probabilities of all words of the vocabulary, the end and each class's unknown words after the first `at` tokens of text, one by one."""
    before = [maxent.token_ids(w)[0] for w in text.split()[:at]]
    kind = lambda i: int(model.classes.of(np.array([i]))[0])

    def row(x, salt):
        x = (x * 0x9E3779B97F4A7C15 + salt * 0xD6E8FEB86659FD93) % (1 << 64)
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) % (1 << 64)
        return max(1, x >> (64 - (len(model.weights) - 1).bit_length()))

    bare = lambda i: int(i) % (1 << 64)
    w1, w2 = (bare(before[-1]) if at else 1), (bare(before[-2]) if at > 1 else 1)
    c1, c2 = (kind(before[-1]) if at else maxent.CLASSES), (kind(before[-2]) if at > 1 else maxent.CLASSES)
    pair = (w1 * 0xFF51AFD7ED558CCD + w2) % (1 << 64)
    rows = [row(w1, 1), row(pair, 2), row(w2, 3), row(c1 * (maxent.CLASSES + 1) + c2, 4)]
    z = np.array([model.weights[0][k] + sum(float(model.weights[r][k]) for r in rows) for k in range(maxent.CLASSES)])
    classes = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    members = defaultdict(list)
    for i in words_seen:
        members[kind(i)].append(i)
    found, unknown = {}, 0.0
    for k in range(maxent.CLASSES):
        if k >= maxent.BY_ENDING:
            found |= {i: classes[k] for i in members[k]}
            unknown += 0 if members[k] else classes[k]  # a class for a word that isn't there
            continue
        held = np.zeros(maxent.PARTS)
        for i in members[k]:
            held[(bare(i)) >> 60] += counts[i] + 1
        unknown += classes[k] / (held.sum() + 1)
        if not members[k]:
            continue
        salted = [(x + k * 0xC4CEB9FE1A85EC53) % (1 << 64) for x in (w1, pair, w2)]
        z = np.array([model_share + sum(float(model.own_weights[row(x, s)][j]) for s, x in zip((5, 6, 7), salted, strict=True)) for j, model_share in enumerate(maxent.shares_of(held[None])[0].astype(float))])
        parts = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        for i in members[k]:
            j = bare(i) >> 60
            found[i] = classes[k] * held.sum() / (held.sum() + 1) * parts[j] * (counts[i] + 1) / held[j]
    return found, unknown


def test_language_model_against_a_forward_pass_word_by_word(spark):
    rng = random.Random(12)
    texts = [prose(rng, rng.choice(["en", "fr", "de"]), 40) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, i % 4 > 0) for i, t in enumerate(texts)], "doc_id bigint, text string, learn boolean")
    kept = []
    real = maxent.learn_model
    try:
        maxent.learn_model = lambda *a: kept.append(out := real(*a)) or out
        got = {r.doc_id: r["__lm_score"] for r in maxent.score(docs).collect()}
    finally:
        maxent.learn_model = real
    model = kept[0][0]
    counts = Counter(int(i) for k, t in enumerate(texts) if k % 4 for i in maxent.token_ids(t))
    text = texts[0]
    ids, total = maxent.token_ids(text), 0.0
    for at, i in enumerate(ids):
        found, unknown = brute_forward(model, counts, counts, text, at)
        assert isclose(sum(found.values()) + unknown, 1, abs_tol=1e-5)
        if int(i) in found:
            total += log10(found[int(i)])
        else:
            k = int(model.classes.of(np.array([i]))[0])
            _, one = None, model.log10(ids, np.array([0]))[0][at]
            assert k < maxent.BY_ENDING
            total += one
    assert isclose(total, got[0], rel_tol=1e-4)


def test_context_tells_parts_of_a_class_apart(spark):
    """Pairs of words that always follow each other, all of one ending: only the factor within the class can tell which follows."""
    rng = np.random.default_rng(3)
    words = [f"w{k}zzz" for k in range(400)]
    text = lambda shift: " ".join(f"{words[k]} {words[(k + shift) % 400]}" for k in rng.integers(0, 400, 200))
    rows = [(i, text(7), True) for i in range(200)] + [(1000, text(7), False), (1001, text(8), False)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, learn boolean").repartition(2)
    got = {r.doc_id: r["__lm_score"] for r in maxent.score(docs).where("NOT learn").collect()}
    assert got[1000] > got[1001] + 20


def test_endings_are_put_together_by_what_they_follow():
    rng = np.random.default_rng(1)
    pairs = np.zeros((maxent.ENDINGS, maxent.FOLLOWED))
    for e in range(200):  # three kinds of endings, each following its own kind
        pairs[e, e % 3 * 20 + rng.integers(0, 20, 300)] += 1
    own = maxent.clustered(pairs, 3)
    assert all(len(set(own[k:200:3])) == 1 for k in range(3)) and len(set(own[:3])) == 3


def test_tables_grow_with_the_vocabulary(spark, monkeypatch):
    sizes = []
    real = maxent.trained
    monkeypatch.setattr(maxent, "trained", lambda *a: sizes.append(tuple(map(len, out := real(*a)))) or out)
    for n in (100, 70_000):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit(True).alias("learn"))
        assert maxent.score(docs).count() == n
    assert sizes == [(1 << 15, 1 << 15), (1 << 16, 1 << 16)]
