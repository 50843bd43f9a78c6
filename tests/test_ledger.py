"""Identities, comparison, governance, integrity, the store and its exchange."""

import hashlib
import json
import random
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridwitness.functions import ed25519, identity
from gridwitness.operators import comparison, governance, integrity, translation
from gridwitness.sources import files
from gridwitness.sources.store import Ledger


def text(s):
    return struct.pack(">I", len(s.encode())) + s.encode()


def state_of(components, ns="gridwitness"):
    out = text(f"{ns}.state/v1") + struct.pack(">I", len(components))
    for name, (digest, size) in sorted(components.items(), key=lambda c: c[0].encode()):
        out += text(name) + text("sha256") + text(digest) + struct.pack(">q", size)
    return hashlib.sha256(out).hexdigest()


def id_of(server, dimension, x, z, seconds, nanos, protocol, contributor, state, ns="gridwitness"):
    out = text(f"{ns}.observation/v1") + text(server) + text(dimension) + struct.pack(">iiqI", x, z, seconds, nanos) + text(protocol) + text(contributor) + text(state)
    return hashlib.sha256(out).hexdigest()


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def records(spark, n=6, contributors=("alice", "bob"), start=0):
    rows = []
    for k in range(start, start + n):
        for c in contributors:
            components = {"mcjava.shape": (digest("shape"), 5), "terrain": (digest(f"terrain{k}"), 8 + len(str(k)))}
            state, at = state_of(components), datetime(2026, 8, 9, 12, k % 60)
            i = id_of("example.org", "overworld", k, -k, int((at - datetime(1970, 1, 1)).total_seconds()), 123456789, "p", c, state)
            rows.append(("gridwitness.observation/v1", i, "example.org", "overworld", k, -k, at.replace(microsecond=123456), 123456789, None, "p", c, "agent", {m: ("sha256", d, s) for m, (d, s) in components.items()}, state))
    from gridwitness.sources.schemas import OBSERVATIONS

    return spark.createDataFrame(rows, OBSERVATIONS)


def objects(spark, n=6, start=0):
    bodies = ["shape"] + [f"terrain{k}" for k in range(start, start + n)]
    return spark.createDataFrame([(digest(b), len(b), b.encode()) for b in bodies], "digest string, size bigint, bytes binary")


def test_identities_follow_from_the_bytes(spark):
    rows = records(spark)
    assert integrity.stored_record_problems(rows).count() == 0
    for change in ({"x": F.col("x") + 1}, {"observed_nanos": F.col("observed_nanos") + 1}, {"contributor": F.lit("eve")}, {"protocol": F.lit("q")}):
        assert {r.detail for r in integrity.stored_record_problems(rows.withColumns(change)).collect()} == {"id doesn't follow from the record"}
    assert integrity.stored_record_problems(rows.withColumn("agent", F.lit("other"))).count() == 0
    assert integrity.stored_record_problems(rows.withColumn("server_id", F.lit("Example.org"))).count() == 2 * 12


def test_times(spark):
    texts = ["2026-08-09T12:34:56Z", "2026-08-09T12:34:56.1+10:00", "2026-08-09T12:34:56.123456789Z", "2026-08-09T12:34:56.000000001Z", "2026-08-09T12:34:56.120-03:30"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(identity.rfc3339_nano(identity.rfc3339_time("t"), identity.rfc3339_nanos("t")).alias("r")).collect()
    assert [r.r for r in got] == ["2026-08-09T12:34:56Z", "2026-08-09T02:34:56.1Z", "2026-08-09T12:34:56.123456789Z", "2026-08-09T12:34:56.000000001Z", "2026-08-09T16:04:56.12Z"]
    assert not spark.range(1).select(identity.is_rfc3339(F.lit("yesterday")).alias("v")).first().v


def test_digests_don_t_depend_on_order_and_settle_comparisons(spark):
    a = records(spark)
    roots = [comparison.archive_root(comparison.server_manifest(comparison.dimension_manifest(comparison.chunk_manifest(x)))).first().root for x in (a, a.orderBy(F.rand(3)).repartition(3), a.where("x < 5"))]
    assert roots[0] == roots[1] != roots[2]
    assert comparison.compare_archives(a, a).count() == 0
    assert [(r.level, r.x, r.kind) for r in comparison.compare_archives(a, a.where("x < 5")).collect()] == [("chunk", 5, "only-local")]
    bob = comparison.fingerprint_states(a.where("contributor = 'bob'"))
    assert comparison.comparison_summary(comparison.compare_fingerprints(comparison.fingerprint_states(a), bob)).first().verdict == "agrees"
    far = a.withColumn("server_id", F.lit("far"))
    assert comparison.comparison_summary(comparison.compare_fingerprints(bob, comparison.fingerprint_states(far))).first().verdict == "not comparable"


def test_fingerprint_text_round_trip(spark):
    a = records(spark)
    states = comparison.fingerprint_states(a)
    parts = comparison.fingerprint_components(a.select(F.explode("components").alias("name", "c")).select("name", "c.digest", "c.size"))
    root = comparison.fingerprint_root(states, parts).first().root
    df = files.fingerprint_lines(states, parts, root, "gridwitness")
    lines = [r.value for r in df.collect()]
    assert lines[0] == "gridwitness.capture-fingerprint/v1" and lines[-1] == f"root {root}"
    with pytest.raises(ValueError):
        files.fingerprint_lines(states.withColumn("server_id", F.lit("a b")), parts, root, "gridwitness")
    assert files.read_fingerprint(df)[2] == root
    body = "".join(x + "\0" for x in lines[1:-1])
    assert hashlib.sha256(body.encode()).hexdigest() == root
    with pytest.raises(ValueError):
        files.read_fingerprint(df.where("NOT value LIKE 'component terrain %'"))


def test_store_append_purge_and_exchange(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    one, two = (Ledger.create(spark, f"file://{tmp_path}/{n}") for n in "ab")
    assert one.append(records(spark), objects(spark)) == {"observations": 12, "already_held": 0, "objects": 7}
    assert one.append(records(spark), objects(spark)) == {"observations": 0, "already_held": 12, "objects": 0}
    assert two.append(records(spark, contributors=("carol",), n=8), objects(spark, n=8))["observations"] == 8
    with pytest.raises(FileExistsError):
        Ledger.create(spark, f"file://{tmp_path}/a")
    with pytest.raises(ValueError):
        one.append(records(spark), spark.createDataFrame([(digest("a"), 1, b"b")], "digest string, size bigint, bytes binary"))
    parts = comparison.fingerprint_components(two.components())
    assert one.send(f"file://{tmp_path}/t1", parts, two.observations())["objects"] == 0
    two.receive(f"file://{tmp_path}/t1")
    two.send(f"file://{tmp_path}/t2", comparison.fingerprint_components(one.components()))
    assert one.receive(f"file://{tmp_path}/t2")["objects"] == 2
    assert one.receive(f"file://{tmp_path}/t2")["observations"] == 0
    root = lambda x: comparison.archive_root(comparison.server_manifest(comparison.dimension_manifest(comparison.chunk_manifest(x.observations())))).first().root
    assert root(one) == root(two)
    r = one.purge(one.observations().where("contributor = 'carol'"))
    assert (r["removed_observations"], r["removed_objects"], r["retained_objects"]) == (8, 2, 7)
    assert one.observations().count() == 12 and one.objects().count() == 7
    assert Ledger.open(spark, f"file://{tmp_path}/a").observations().count() == 12


def test_two_writers_lose_nothing(spark, tmp_path):
    """Another writer publishes between reading the version and publishing the next; the change is worked out anew."""
    root = f"file://{tmp_path}/w"
    one, two = Ledger.create(spark, root), Ledger.open(spark, root)
    real, done = one._write, []

    def write(kind, rows):
        if not done:
            done.append(two.append(records(spark, n=3, contributors=("bob",))))
        return real(kind, rows)

    one._write = write
    assert one.append(records(spark, n=4)) == {"observations": 5, "already_held": 3, "objects": 0}
    assert one.observations().count() == 8 == one.observations().select("id").distinct().count()
    assert [json.loads((tmp_path / "w" / "versions" / n).read_text())["version"] for n in one._versions()] == [0, 1, 2]
    assert len(list((tmp_path / "w" / "observations").iterdir())) == 2  # what was written for the refused version is gone
    assert not one._publish({"format": "1", "version": 2, "observations": [], "objects": []}) and one.observations().count() == 8
    before = set(one._pointer()["observations"])
    one.purge(records(spark, n=1, contributors=("alice",)))  # alice's first is in one of the two folders
    assert len(before & set(one._pointer()["observations"])) == 1 and one.observations().count() == 7


def test_a_tampered_transfer_is_refused_whole(spark, tmp_path):
    ledger = Ledger.create(spark, f"file://{tmp_path}/c")
    for name, rows, things in (("x", records(spark).withColumn("x", F.col("x") + 1), objects(spark)), ("y", records(spark), objects(spark, n=2))):
        rows.write.parquet(f"file://{tmp_path}/{name}/observations")
        things.write.parquet(f"file://{tmp_path}/{name}/objects")
        doc = {"schema": "gridwitness.transfer-bundle/v1", "observations": [r.id for r in rows.collect()], "objects": [{"digest": r.digest, "size": r.size} for r in things.collect()]}
        for listed in ({**doc, "schema": "x"}, {**doc, "observations": doc["observations"][1:]}, {**doc, "objects": [*doc["objects"], doc["objects"][0]]}, doc):
            (tmp_path / name / "bundle.json").write_text(json.dumps(listed))
            with pytest.raises(ValueError, match={"x": "id doesn't follow", "y": "resolved"}[name] if listed is doc else "schema|lists"):
                ledger.receive(f"file://{tmp_path}/{name}")
    assert ledger.observations().count() == 0


def test_references(spark):
    obs = records(spark, n=3)
    index = obs.select("server_id", "dimension", "x", "z", "id")
    parts = obs.select("id", F.explode("components").alias("name", "c")).select("id", "name", "c.digest", "c.size")
    held = objects(spark, n=3)
    kinds = lambda *a: sorted({r.kind for r in integrity.reference_problems(*a).collect()})
    assert kinds(obs, index, parts, held) == []
    assert kinds(obs, index.union(index.limit(1)), parts, held) == ["indexed twice"]
    assert kinds(obs.where("x > 0"), index, parts, held) == ["index without record"]
    assert kinds(obs, index.where("x > 0"), parts, held.where("size <> 5")) == ["missing object", "record without index"]
    assert kinds(obs, index.withColumn("x", F.col("x") + 1), parts, held) == ["indexed in another cell"]
    assert integrity.object_problems(held.withColumn("bytes", F.lit("?").cast("binary"))).count() == held.count()


def test_signatures(spark):
    # fixed values: the first two test vectors of RFC 8032
    for seed, key, message, signature in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", b"", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", b"\x72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ):
        assert ed25519.public_key(bytes.fromhex(seed)).hex() == key and ed25519.sign(bytes.fromhex(seed), message).hex() == signature
        assert ed25519.verify(key, signature, message) and not ed25519.verify(key, signature, message + b"x") and not ed25519.verify(key, "zz", message)
    obs = records(spark, n=2)
    seed = "11" * 32
    signed = governance.with_valid_signatures(governance.sign_all(obs, seed, " ALICE"))
    assert signed.count() == 2 and signed.where("valid").count() == 2
    forged = signed.drop("valid").withColumn("signature", F.concat(F.lit("00"), F.expr("substr(signature, 3)")))
    people = spark.createDataFrame([("alice", ed25519.public_key(bytes.fromhex(seed)).hex())], "label string, public_key string")
    t = governance.attestation_tally(obs, signed.unionByName(governance.with_valid_signatures(forged)), people).first()
    assert (t.unattested, t.recognised, t.unregistered, t.invalid) == (2, 2, 0, 2)


def test_clusters_against_flood_fill(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(3)
    points = {(x, z) for x in range(-40, 41) for z in range(-40, 41) if rng.random() < 0.62} | {(x, 500) for x in range(-70, 70)}
    left, sizes = set(points), []
    while left:
        stack, n = [left.pop()], 0
        while stack:
            x, z = stack.pop()
            n += 1
            for p in ((x + 1, z), (x - 1, z), (x, z + 1), (x, z - 1)):
                if p in left:
                    left.remove(p)
                    stack.append(p)
        sizes.append(n)
    df = spark.createDataFrame([("s", "d", x, z) for x, z in points] + [("s", "e", 0, 500)], "server_id string, dimension string, x int, z int")
    assert sorted(r["size"] for r in governance.clusters(df).collect()) == sorted(sizes)
    e = governance.exposure(df).first()
    assert e.chunks == len(points) + 1 and e.largest_cluster == max(sizes) and e.exposure == "substantial"


def test_exposure_counts_both_dimensions(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.createDataFrame([("s", d, x, z) for d in "de" for x in range(32) for z in range(32)], "server_id string, dimension string, x int, z int")
    e = governance.exposure(df).first()
    assert e.densest_region_fill == 2.0 and e.largest_cluster == 1024


def test_a_corridor_of_regions_takes_few_rounds(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.range(64 * 32).select(F.lit("s").alias("server_id"), F.col("id").cast("int").alias("x"), F.lit(7).alias("z"))
    from pyspark.sql import DataFrame

    rounds = []
    real = DataFrame.isEmpty
    monkeypatch.setattr(DataFrame, "isEmpty", lambda self: rounds.append(1) or real(self))
    assert [(r.root, r["size"]) for r in governance.clusters(df).collect()] == [((1 << 63) + (1 << 31) + 7 - (1 << 63), 64 * 32)]
    assert len(rounds) - 1 <= 10


def test_landmarks_of_any_size(spark):
    rng = random.Random(6)
    cells = {(rng.choice("ab"), "d", rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(400)} | {("a", "d", 2**31 - 1, -(2**31)), ("a", "d", 0, 0)}
    boxes = [("a", "d", f"n{k}", *(sorted(rng.sample(range(-350, 350), 2)) + sorted(rng.sample(range(-350, 350), 2)))) for k in range(30)]
    marks = [(s, d, n, x0, z0, x1, z1) for s, d, n, x0, x1, z0, z1 in boxes] + [("a", "d", "world", -(2**30), -(2**31), 2**30, -1), ("b", "d", "one", 0, 0, 0, 0), ("c", "d", "none", 0, 0, 9, 9)]
    got = governance.landmark_coverage(spark.createDataFrame(sorted(cells), "server_id string, dimension string, x int, z int"), spark.createDataFrame(marks, "server_id string, dimension string, name string, min_x int, min_z int, max_x int, max_z int"))
    found = {r.name: (r.observed, r.total) for r in got.collect()}
    for s, d, n, x0, z0, x1, z1 in marks:
        assert found[n] == (sum(c[0] == s and x0 <= c[2] <= x1 and z0 <= c[3] <= z1 for c in cells), (x1 - x0 + 1) * (z1 - z0 + 1))


def test_policies(spark):
    rows = [(" Private", None), ("embargoed", "2024-01-02 00:00:00"), ("Embargoed", "2024-01-01 00:00:00"), ("research", None), ("public", None), ("embargo", None), (None, None)]
    df = spark.createDataFrame(rows, "disposition string, until string").select("disposition", F.col("until").cast("timestamp_ntz").alias("embargo_until"))
    got = df.select(governance.may_distribute(F.col("disposition"), F.col("embargo_until"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).alias("r")).select("r.*").collect()
    assert [(r.allowed, r.reason) for r in got] == [(False, "private"), (False, "under embargo"), (True, "the embargo is over"), (False, "research only"), (True, "public"), (False, "unknown disposition"), (False, "no policy was declared")]
    whole = df.withColumns({"server": F.lit("s"), "declared_by": F.lit("me"), "declared_at": F.lit("2024-01-01").cast("timestamp")})
    faults = [r.problems for r in governance.validated(whole, "policy").collect()]
    assert faults == [[], [], [], [], [], ["disposition is known"], ["disposition is known", "an embargo, and nothing else, has an end"]]
    odd = whole.withColumns({"embargo_until": F.lit("2025-01-01").cast("timestamp_ntz"), "declared_by": F.lit(" ")}).where("disposition = 'public'")
    assert governance.validated(odd, "policy").first().problems == ["declared_by is required", "an embargo, and nothing else, has an end"]


def test_manifests_are_computed_anew_when_read(spark, tmp_path):
    from gridwitness.sources import documents

    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    obs = records(spark).unionByName(records(spark, n=2).withColumn("server_id", F.lit("other")))
    parts = obs.select("id", F.explode("components").alias("name", "c")).select("id", "name", "c.digest", "c.size")
    path = f"file://{tmp_path}/manifest.json"
    root = documents.write_ledger_manifest(obs, parts, path, "2026-01-01T00:00:00Z")
    cells, again = documents.read_ledger_manifest(spark, path)
    assert root == again and cells.exceptAll(comparison.chunk_manifest(obs).select(*cells.columns)).count() == 0 and cells.count() == 8
    doc = json.loads((tmp_path / "manifest.json").read_text())
    assert doc["observations"] == 16 and doc["servers"][0]["dimensions"][0]["earliest"] == "2026-08-09T12:00:00.123456789Z"
    doc["servers"][0]["dimensions"][0]["chunk_digests"][0]["digest"] = "0" * 64
    (tmp_path / "bad.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="root"):
        documents.read_ledger_manifest(spark, f"file://{tmp_path}/bad.json")
    with pytest.raises(ValueError, match="schema"):
        documents.read_ledger_manifest(spark, path, "elsewhere")
    from gridwitness.operators import selection

    at = "2026-08-09 12:03:00"
    own = selection.select_at(selection.gather(obs, None, "example.org", "overworld"), at)
    epoch = comparison.epoch_manifest(own)
    summary = selection.status_summary(own).first().asDict()
    path = f"file://{tmp_path}/epoch.json"
    root = documents.write_epoch_manifest(epoch, summary, path, "example.org", "overworld", at, "2026-01-01T00:00:00Z")
    rows, about = documents.read_epoch_manifest(spark, path)
    assert about["root"] == root and about["summary"]["unknown"] == 3 and rows.count() == 6 and comparison.compare_epochs(epoch, rows).where("kind <> 'equal'").count() == 0
    (tmp_path / "cut.json").write_text((tmp_path / "epoch.json").read_text().replace('"x": 1,', '"x": 9,'))
    with pytest.raises(ValueError, match="root"):
        documents.read_epoch_manifest(spark, f"file://{tmp_path}/cut.json")


def test_profiles_rules_and_evidence(spark, tmp_path):
    from gridwitness.sources import documents

    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    put = lambda name, doc: (tmp_path / name).write_bytes(b"\xef\xbb\xbf" + json.dumps(doc).encode()) and f"file://{tmp_path}/{name}"
    profile = {"schema": "gridwitness.minecraft-profile/v1", "version": "9", "data_version": 5, "dimensions": {"m:o": {"min_section_y": -4, "section_count": 24}}, "blocks": ["m:air", "m:new", "m:stone"], "biomes": ["m:plains"]}
    head, entries = documents.read_profile(spark, put("p.json", profile))
    assert head["data_version"] == 5 and {tuple(r) for r in entries.where("kind <> 'block'").collect()} == {("biome", "m:plains", ""), ("dimension", "m:o", "-4:24")}
    for change in ({"version": " "}, {"blocks": ["b", "a"]}, {"biomes": []}, {"surprise": 1}, {"schema": "x"}, {"dimensions": {"d": {"min_section_y": 0, "section_count": 0}}}):
        with pytest.raises(ValueError):
            documents.read_profile(spark, put("q.json", {**profile, **change}))
    rules = documents.read_rules(spark, put("r.json", {"schema": "gridwitness.translation-rules/v1", "renames": {"m:old": "m:new", "odd": "m:stone"}, "substitutions": {"m:old": {"block": "m:gone"}, "m:odd": {"block": "m:stone", "keep_properties": True}}, "biome_renames": {"m:a": "m:plains"}}))
    assert {tuple(r) for r in documents.rule_problems(rules, entries).collect()} == {("block", "m:old", "the target has no such name"), ("block", "odd", "not a name with a namespace"), ("block", "m:old", "renamed and substituted")}
    sections = spark.createDataFrame([("c1", 0, ["m:odd[a=b]", "m:stone"], [0, 1]), ("c2", 0, ["m:bad"], [0, 0]), ("c3", 99, ["m:stone"], [0, 0])], "chunk string, section_y int, palette array<string>, indices array<int>")
    block = rules.where("of = 'block'").drop("of")
    out = translation.translate_for_target(sections, entries, block, head["dimensions"]["m:o"])[0]
    assert [(r.chunk, r.palette) for r in out.collect()] == [("c1", ["m:stone", "m:stone[a=b]"])]
    with pytest.raises(ValueError, match="1 states at 2 positions can't be shown, 1 sections"):
        translation.translate_for_target(sections, entries, block, head["dimensions"]["m:o"], "report")
    o = {"placement": {"spacing": 32, "separation": 8, "salt": 5, "spread_type": "linear"}, "chunk": {"x": 3, "z": -4}}
    evidence = {"schema": "gridwitness.seed-observations/v1", "observations": [o]}
    assert documents.read_evidence(spark, put("e.json", evidence)) == [{"spacing": 32, "separation": 8, "salt": 5, "spread_type": "linear", "x": 3, "z": -4}]
    for bad in ({**evidence, "observations": []}, {**evidence, "observations": [{**o, "placement": {**o["placement"], "separation": 32}}]}, {**evidence, "schema": "x"}):
        with pytest.raises(ValueError):
            documents.read_evidence(spark, put("f.json", bad))


def test_status_and_words(spark):
    from gridwitness.operators import status

    obs, none = records(spark), records(spark).limit(0)
    policies = spark.createDataFrame([("example.org", "Private", None)], "server string, disposition string, embargo_until timestamp_ntz")
    steps = [status.next_step(o, p, r) for o, p, r in ((obs, policies, 2), (none, policies, None), (none, policies, 0), (obs, policies.limit(0), 0), (obs, policies, None))]
    assert steps == list(status.STEPS)
    r = status.server_status(obs, policies, "2026-01-01 00:00:00").first()
    assert (r.dimensions, r.chunks, r.observations, r.declared, r.allowed) == (1, 6, 12, True, False)
    shown, more = status.truncated(obs.orderBy("id"), 5)
    assert shown.count() == 5 and more == 7 and status.truncated(obs, 0)[1] == 0 and status.truncated(obs, 50)[1] == 0
    reds = spark.createDataFrame([("s", None, "d", 1, 2, 3, 4), ("s", "c", "", None, None, None, None)], "server_id string, contributor string, dimension string, min_x int, min_z int, max_x int, max_z int")
    assert [r.t for r in reds.select(status.redaction_text().alias("t")).collect()] == ["server s; every contributor; dimension d; x 1 to 3, z 2 to 4", "server s; contributor c; every dimension; every place"]
    assert policies.select(status.policy_text().alias("t")).first().t == "example.org: private"


def test_declarations(spark):
    df = spark.createDataFrame([("s", None, "why", None, 1, 1, 0, 0)], "server_id string, declared_by string, reason string, declared_at timestamp, min_x int, min_z int, max_x int, max_z int")
    assert governance.validated(df, "redaction").first().problems == ["declared_by is required", "declared_at is required", "bounds are in order"]
    old = spark.createDataFrame([("1", "a", 1), ("2", "b", 1)], "id string, v string, declared_at int")
    new = spark.createDataFrame([("1", "c", 2)], old.schema)
    assert {(r.id, r.v) for r in governance.upsert(old, new).collect()} == {("1", "c"), ("2", "b")}
    assert [r.id for r in governance.withdraw(old, ["1", "9"]).collect()] == ["2"]
    with pytest.raises(PermissionError):
        governance.export_gate(spark.createDataFrame([("a", "private")], "server string, disposition string"), "b")


def test_translation(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    target = spark.createDataFrame([("m:stone",), ("m:new",), ("m:air",)], "name string")
    rules = spark.createDataFrame([("rename", "m:old", "m:new", True), ("substitution", "m:odd", "m:stone", False), ("rename", "m:bad", "m:gone", True)], "kind string, source string, target string, keep_properties boolean")
    sections = spark.createDataFrame([("c1", 0, ["m:odd[a=b]", "m:old[x=y]", "m:stone"], [0, 1, 2, 2]), ("c2", 0, ["m:bad"], [0, 0, 0, 0]), ("c1", 99, ["m:stone"], [0, 0, 0, 0])], "chunk string, section_y int, palette array<string>, indices array<int>")
    out, report, dropped = translation.translate_chunks(sections, target, rules, -4, 24)
    assert [(r.chunk, r.palette, r.indices) for r in out.collect()] == [("c1", ["m:new[x=y]", "m:stone"], [1, 0, 1, 1])]
    assert {(r.source, r.outcome, r.target, r.positions) for r in report.collect()} == {("m:odd[a=b]", "substituted", "m:stone", 1), ("m:old[x=y]", "renamed", "m:new[x=y]", 1), ("m:bad", "skipped", None, 4)}
    assert [(r.chunk, r.dropped_sections) for r in dropped.collect()] == [("c1", 1)]
    filled = translation.translate_chunks(sections, target, rules, -4, 24, "fill")[0]
    assert {r.chunk: r.palette for r in filled.collect()}["c2"] == ["minecraft:air"]
    before = spark.createDataFrame([("block", "a", ""), ("dimension", "d", "-4:24"), ("structure_set", "v", "1")], "kind string, name string, value string")
    after = spark.createDataFrame([("block", "b", ""), ("dimension", "d", "-4:20"), ("structure_set", "v", "2")], before.schema)
    delta = translation.profile_delta(before, after)
    assert {(r.name, r.change) for r in delta.collect()} == {("a", "removed"), ("b", "added"), ("d", "narrowed"), ("v", "changed")}
    assert translation.touches_existing(delta).first().affected and not translation.touches_existing(delta.where("change = 'added'")).first().affected


def bundle(folder, name, bodies, **changes):
    own = folder / f"ready-{name}"
    (own / "components").mkdir(parents=True)
    doc = {
        "schema": "gridwitness.capture-bundle/v1", "server_id": " Example.ORG", "dimension": "overworld", "chunk": {"x": 1, "z": -2}, "observed_at": "2026-08-09T12:34:56.123+10:00", "protocol": "p",
        "source": {"contributor": "alice"}, "capture": {"session_id": "s", "sequence": 1, "trigger": "t"}, "components": {},
    }
    for part, body in bodies.items():
        (own / "components" / part).write_bytes(body)
        doc["components"][part] = {"path": f"components/{part}", "algorithm": "sha256", "digest": hashlib.sha256(body).hexdigest(), "size": len(body)}
    (own / "bundle.json").write_text(json.dumps({**doc, **changes}))
    return own


def test_spool_stream(spark, tmp_path):
    from gridwitness.streaming.ingest import ingest_spool

    spool = tmp_path / "spool"
    bundle(spool, "a", {"x": b"1", "y": b"22"})
    bundle(spool, "b", {"x": b"1", "y": b"3"}, source={"contributor": "bob"})
    (bundle(spool, "c", {"x": b"1"}, source={"contributor": "carol"}) / "components" / "x").write_bytes(b"altered")
    bundle(spool, "d", {"x": b"1"}, surprise=1)
    twice = bundle(spool, "e", {"x": b"1"}) / "bundle.json"
    twice.write_text(twice.read_text().replace('"protocol": "p"', '"protocol": "p", "protocol": "q"'))
    bundle(spool, "f", {"x": b"1"}, components={"x": {"path": "../x", "algorithm": "sha256", "digest": "0" * 64, "size": 1}})
    Ledger.create(spark, f"file://{tmp_path}/ledger")
    for _ in range(2):  # the second run finds nothing new
        ingest_spool(spark, str(spool), f"file://{tmp_path}/ledger", str(tmp_path / "cp"), str(tmp_path / "bad"), 2).awaitTermination()
    ledger = Ledger.open(spark, f"file://{tmp_path}/ledger")
    rows = ledger.observations().orderBy("contributor").collect()
    assert [r.contributor for r in rows] == ["alice", "bob"] and rows[0].server_id == "example.org" and rows[0].observed_nanos == 123000000
    assert rows[0].observed_at == datetime(2026, 8, 9, 2, 34, 56, 123000)
    assert integrity.stored_record_problems(ledger.observations()).count() == 0
    assert ledger.objects().count() == 3
    reasons = {r.bundle.rsplit("-", 1)[1]: r.problems for r in spark.read.json(str(tmp_path / "bad" / "*")).collect()}
    assert sorted(reasons) == ["c", "d", "e", "f"] and "altered" in reasons["c"][0] and "surprise" in reasons["d"][0] and "twice" in reasons["e"][0]
    ledger_files = files.spool_counts(spark, str(spool)).collect()
    assert [(r.kind, r.bundles) for r in ledger_files] == [("ready", 6)]
