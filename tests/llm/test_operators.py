"""Each operator against a brute-force version on small rows: nulls, empty and long texts, repeated rows, empty tables, clashing column names."""

import base64
import collections
import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from panelkiln.llm import bpe, exact_dedup, near_dups, packing, partenum, secrets, tool_calls, topk, toxicity, url_rules, warc
from panelkiln.llm.shared import fresh_dir, set_for

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [None, "", " \n ", "one", "Two words", "a b c d e", "A B C D E"]
    for _ in range(12):
        t = prose(rng, rng.choice([20, 60, 300]))
        out += [t, t, t.upper()]
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    out.append(prose(rng, 30_000))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, keep_id string, _toxic int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_exact_dedup(docs, texts, none):
    got = as_dict(exact_dedup.exact_dedup(docs))
    by = collections.defaultdict(list)
    for i, t in enumerate(texts):
        by[t or ""].append(i)
    for i, t in enumerate(texts):
        same = by[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_of_hot_groups(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(3000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    want = duckdb.sql("with documents as (select i as doc_id, case when i % 3 = 0 then 'hot' else 't' || (i // 2) end as text from range(3000) t(i)) " + exact_dedup.OP3_SQL[1:]).fetchall()
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == sorted(want)


def test_secret_scan(spark):
    rng = random.Random(1)
    random_b64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60))
    texts = [
        None, "", "token = 'abcdef'", "secret=token: abcdefgh", "é API_KEY:\"abc\" and apikey=abcdefg", "AKIA" + "A1" * 8 + " AKIAB", "x" + "0a" * 12 + "y", "0a" * 11, "😀 password = hunter2hunter2 ſecret=abcdefgh",
        "token=abcdef " * 700, f"see {random_b64} here", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "internationalizationandlocalization",
    ]
    forms = [(re.compile(secrets.ASSIGN.removeprefix("(?i)"), re.I | re.A), lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    got = as_dict(secrets.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        found = sorted((m.start(), k, m.end()) for k, (f, ok) in enumerate(forms) for m in f.finditer(t or "") if ok(m))
        named = ",".join(f"{secrets.BASE_KINDS[k]}:{a}:{b}" for a, k, b in found)
        assert got[i]["base_sha256"] == hashlib.sha256(named.encode()).hexdigest(), t
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("random")] == [x for x in named.split(",") if x]
    assert got[10]["n_random"] == 1 and got[11]["n_random"] == 0 and got[12]["n_random"] == 0


def test_redaction_keeps_documents(spark):
    df = spark.createDataFrame([(1, "my token = abcdefgh ok", 22, "z"), (2, None, 0, "z"), (3, "clean", 5, "z")], "doc_id long, text string, n_chars long, _base string")
    got = as_dict(secrets.redact(spark, df))
    assert got[1]["text"] == "my [SECRET] ok" and got[1]["n_chars"] == 14 and got[2]["text"] is None and got[3]["text"] == "clean" and got[1]["_base"] == "z"


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        bad = rng.random() < 0.2
        rows.append((i, prose(rng, 40) + (" " + " ".join(rng.choice(["idiotic", "idiots", "scum"]) for _ in range(3)) if bad else "")))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    df = spark.createDataFrame(rows + [(5000, None), (5001, "")], "doc_id long, text string")
    got = as_dict(toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert len(got) == 1502 and 0 <= got[5000]["score"] <= 1 and got[5000]["predicted"] == 0
    for i, t in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    right = [got[i]["predicted"] == int("idiot" in t or "scum" in t) for i, t in rows if got[i]["held_out"]]
    assert sum(right) > 0.95 * len(right)
    assert {r["score"] for r in toxicity.toxicity(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0.0}


def near_brute(texts, ids):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("whole", [near_dups.WHOLE_GROUP, 2])
def test_near_duplicates(docs, texts, none, whole):
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in as_dict(near_dups.near_duplicates(docs, whole)).items()}
    assert got == near_brute(texts, range(len(texts)))
    assert near_dups.near_duplicates(none).count() == 0


def test_sql_of_near_duplicates_and_archives(spark, docs):
    con = duckdb.connect()
    kept = docs.filter("length(coalesce(text, '')) < 9000")
    con.register("documents", kept.select("doc_id", "text").toPandas().astype({"text": object}))
    got = sorted(map(tuple, near_dups.near_duplicates(kept).collect()))
    assert got == sorted(con.sql(near_dups.OP4_SQL).fetchall())
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 700)], "page_id long, url string, html string")
    con.register("pages", pages.toPandas().astype({"html": object}))
    got = warc.warc_round_trip(pages, fresh_dir(spark, "t")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(warc.OP6_SQL).fetchall())


def test_near_duplicates_of_chains(spark):
    """Texts that drift: neighbours are similar, ends aren't."""
    base = [f"u{i}" for i in range(60)]
    texts = [" ".join(base[k : k + 40]) for k in range(0, 20, 2)] + [" ".join(f"v{j % 7}x{i}" for i in range(j)) for j in range(1, 12)]
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in as_dict(near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).items()}
    assert got == near_brute(texts, range(len(texts)))


def test_similar_sets_share_signatures():
    rng = np.random.default_rng(0)
    for _ in range(400):
        size = int(rng.integers(1, 300))
        s = np.unique(rng.integers(0, 2**63, size).astype("u8"))
        t = s[rng.random(len(s)) > rng.random() * 0.2]
        t = np.unique(np.append(t, rng.integers(0, 2**63, int(rng.integers(0, 2 + size // 12))).astype("u8")))
        both = len(np.intersect1d(s, t))
        if len(t) and 100 * both >= 75 * (len(s) + len(t) - both):
            common = len(np.intersect1d(partenum.signatures(s), partenum.signatures(t)))
            assert common >= max(partenum.shared_at_least(len(s)), partenum.shared_at_least(len(t)))
            assert len(np.intersect1d(partenum.fine_signatures(s), partenum.fine_signatures(t)))
        assert partenum.least_distance(partenum.sketch(s), partenum.sketch(t)) <= len(s) + len(t) - 2 * both


def test_fine_signatures_of_strangers_and_of_similar_sets():
    """Strangers don't meet in empty partitions; sets at the largest distance meet however the differences fall."""
    rng = np.random.default_rng(1)
    each = [partenum.fine_signatures(np.unique(rng.integers(0, 2**63, 300).astype("u8"))) for _ in range(300)]
    _, n = np.unique(np.concatenate(each), return_counts=True)
    assert (n * (n - 1) // 2).sum() < 30
    for size in [*range(1, 60), 100, 250, 700]:
        s = np.unique(rng.integers(0, 2**63, size).astype("u8"))
        lost = size - -(-75 * size // 100)
        for family in range(max(0, partenum.band_of(size) - 1), partenum.band_of(size) + 1):
            for n in {partenum.plan(family, 75) // 3 + 1, (o := partenum.plan(family, 75) // 3 + 1) + (o + 2) // 6}:
                seed = partenum.mix(np.array([family * 7919 + 29], "u8"))[0]
                inner = (partenum.mix(s ^ seed) % np.uint64(n * 5)).astype(int)
                for most in (1, 2, 3, 5):  # differences of a first-level partition, each in an inner one of its own
                    order = np.lexsort((rng.random(size), inner))
                    first = order[np.append(True, np.diff(inner[order]) != 0)]
                    rank = np.array([(inner[first[:i]] // 5 == inner[x] // 5).sum() for i, x in enumerate(first)])
                    gone = np.concatenate([first[rank < most], rng.permutation(np.setdiff1d(np.arange(size), first[rank < most]))])[:lost]
                    t = np.delete(s, gone)
                    assert len(np.intersect1d(partenum.fine_signatures(s), partenum.fine_signatures(t)))


def test_needed_sets_stay_where_they_are(spark):
    rng = random.Random(5)
    text = spark.createDataFrame([(i, prose(rng, 30)) for i in range(40)], "doc_id long, text string")
    nodes = spark.createDataFrame([(partenum.node_of(partenum.shingles_of([r["text"]])[0]), r["doc_id"]) for r in text.collect() if r["doc_id"] % 2], "node long, doc_id long")
    sets = near_dups.needed_sets(text, nodes)
    assert sorted(r["node"] for r in sets.collect()) == sorted(r["node"] for r in nodes.collect())
    with set_for(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        joined = sets.join(nodes, "node", "left")
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert joined.filter("doc_id is not null").count() == 20


def test_exact_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(300)]
    rows += [(301, None), (302, [None] * 8), (303, [float("nan")] * 8), (304, [1.0]), (320, rows[7][1]), (320, rows[9][1]), (None, rows[0][1])]
    got = sorted(map(tuple, topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    ints = [(i, np.floor(64 * np.array(v, "f4").astype("f8")).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in ints:
        if q % 20 == 0:
            best = sorted((-int(v @ w), c) for c, w in ints if c != q and len(w) == len(v))[:20]
            want += [(q, c, -s) for s, c in best]
    # A repeated query id asks for the best of all its vectors together.
    single = sorted(x for x in want if x[0] != 320)
    assert sorted((q, c, s) for q, _, c, s in got if q != 320) == single
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_exact_top_k_of_ties_and_wide_ranges(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 6)) * rng.choice([1.0, 1e3, 1e6], size=(400, 1))
    v[100:250] = v[100]
    v[260] = 0
    rows = [(i, x.tolist(), -1, "clash") for i, x in enumerate(v)] + [(500, [], 0, ""), (501, [], 0, ""), (520, [float("inf")] * 6, 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, uid int, q string").repartition(5)
    got = sorted(map(tuple, topk.exact_top_k(df).collect()))
    ints = np.floor(64 * v).astype(int).astype(object)
    want = [(500, 1, 501, 0)]
    for q in range(0, 400, 20):
        best = sorted((-int(ints[q] @ ints[c]), c) for c in range(400) if c != q)[:20]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got == sorted(want)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for scale in (10, 10**4, 10**9):
        c, q = rng.integers(-scale, scale, (300, 12)), rng.integers(-scale, scale, (20, 12))
        low, width, cells = topk.quantise(c)
        near, slack = topk.bounds(q, low, width, cells)
        true = (q.astype(object) @ c.T.astype(object)).astype("f8")
        assert (np.abs(true - near) <= slack[:, None]).all()


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u y", "é" * 5000), (5, "u", "x"), (None, "n", "x"), (9, "http://q", "<p>\r\n\r\n</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnsRenamed({})
    got = warc.warc_round_trip(df, fresh_dir(spark, "t"), roll_bytes=500).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(1, 1, digest("x"), "revisit", 5), (2, 1, digest("x"), "revisit", 5), (3, 0, digest(""), "revisit", 4), (4, 0, digest(""), "response", None), (5, 10000, digest("é" * 5000), "response", None),
            (5, 1, digest("x"), "response", None), (None, 1, digest("x"), "response", None), (9, 11, digest("<p>\r\n\r\n</p>"), "response", None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    a, b = fresh_dir(spark, "t"), fresh_dir(spark, "t")
    assert warc.write_archives(df, a).collect() == warc.write_archives(df, b).collect()
    assert warc.warc_round_trip(df.limit(0), fresh_dir(spark, "t")).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://x.com", "http://x.com/a", "HTTP://WWW.Example.COM/en/1?q#f", "https://m.example.com/en/2", "https://notexample.com/en/", "ftp://a.net/es/1", "http://a.net/fr/?x", "http://net/es/", "http://a.org/en/5"]
    urls += [f"http://h{i}.example.net/{'es' if i % 2 else 'de'}/{i}" for i in range(40)]
    got = as_dict(url_rules.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), "page_id")

    def brute(u):
        if not u or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit, key=lambda x: len(x[0]), default=None)

    for i, u in enumerate(urls):
        host, path, rule = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[0])
        assert got[i]["verdict"] in ("allow", "block") and (rule is None or got[i]["verdict"] == rule[1])


def test_mined_rules_match_by_join_as_by_index(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    a = as_dict(url_rules.url_filter(pages), "page_id")
    before, url_rules.INLINE_RULES = url_rules.INLINE_RULES, 0
    try:
        b = as_dict(url_rules.url_filter(pages), "page_id")
    finally:
        url_rules.INLINE_RULES = before
    assert {k: r["verdict"] for k, r in a.items()} == {k: r["verdict"] for k, r in b.items()}


def test_bpe_is_tiktoken(docs, texts, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ours = bpe.load(path, P.PATTERN)
    theirs = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    rng = random.Random(0)
    parts = ["a", "th", "the", " ", "  ", "\n", "'s", "é", "1", "²", "漢", "\x1c", "\x85", "\xa0", "😀", "_", "!", "ing", "\t", "ª", "٣", "́", "<|endoftext|>"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == theirs.encode_ordinary(t), t
    got = as_dict(bpe.bpe_round_trip(docs, path, P.PATTERN))
    for i, t in enumerate(texts):
        ids = np.array(theirs.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.bpe_round_trip(none, path, P.PATTERN).count() == 0


def test_packing(docs, texts, none):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, with_ids=True).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and 0 < r["length"] <= 1024
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces), "<u4").tolist() == ids
        assert all(r["doc_tokens"] == len(ids) for r in pieces)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert packing.pack_documents(none, path).count() == 0


def test_shortest_pack_first_places_all():
    rng = random.Random(0)
    h = {n: rng.randrange(1, 10**6) for n in rng.sample(range(1, 1025), 300)}
    packs = packing.shortest_pack_first(h, 1024)
    assert all(sum(p) <= 1024 for p, _ in packs)
    placed = collections.Counter()
    for p, n in packs:
        for x in p:
            placed[x] += n
    assert placed == h and len(packs) < 5000


def test_tool_calls(spark):
    schema = {"type": "object", "required": ["q"], "additionalProperties": False, "properties": {"q": {"type": "string"}, "n": {"type": "integer", "minimum": 1}}}
    calls = [("a", None, "f", '{"q": "x", "n": 2.0}'), ("b", "a", "f", '{"n": 0}'), ("c", "b", "g", "{}"), ("d", "gone", "f", "no json"), ("x", "y", "f", '{"q": ""}'), ("y", "x", "f", None), (None, None, "f", '{"q": "z"}')]
    calls += [(f"k{i}", f"k{i - 1}", "f", '{"q": "k"}') for i in range(50)]
    results = [("a", "r2"), ("a", "r1"), ("lost", "r"), ("c", None), (None, "n")]
    got = tool_calls.link_tool_calls(spark.createDataFrame(calls, "call_id string, parent_id string, name string, arguments string"), spark.createDataFrame(results, "call_id string, content string"), {"f": schema}).collect()
    by = {r["call_id"]: r for r in got}
    assert len(got) == len(calls) + 1
    assert by["a"]["message"] == '{"arguments":{"n":2,"q":"x"},"call_id":"a","name":"f","result":"r1"}' and by["a"]["n_results"] == 2 and by["a"]["valid"]
    assert by["b"]["errors"] == "$.q: missing; $.n: minimum 1" and by["c"]["errors"] == "$: no schema" and by["d"]["errors"] == "$: no JSON"
    assert [by[x]["depth"] for x in "abcd"] == [0, 1, 2, 0] and by["c"]["root_id"] == "a" and by["x"]["cyclic"] and by["y"]["cyclic"]
    assert by["k49"]["depth"] == 49 and by["lost"]["status"] == "no_call" and by["b"]["status"] == "no_result" and by["c"]["status"] == "linked"
    assert json.loads(by["k3"]["message"])["arguments"] == {"q": "k"}


def test_each_result_of_a_call_has_a_row(spark):
    calls = [("a", None, "f", "{}"), ("a", None, "f", "[]"), ("b", "a", "f", "{}"), ("hot", "b", "f", "{}"), (None, None, "f", "{}")]
    results = [("a", "r2"), ("a", "r1"), ("a", "r1"), ("a", None), ("lost", "x"), ("lost", "y"), (None, "n"), (None, "n"), (None, None)] + [("hot", f"h{i}") for i in range(3000)]
    args = spark.createDataFrame(calls, "call_id string, parent_id string, name string, arguments string"), spark.createDataFrame(results, "call_id string, content string").repartition(4), {"f": {"type": "object"}}
    got = [(r["call_id"], r["status"], json.loads(r["message"])["result"], r["n_results"], r["depth"], r["valid"]) for r in tool_calls.link_tool_calls(*args, every_result=True).collect()]
    of = lambda x: sorted((r[1:] for r in got if r[0] == x), key=str)
    assert of("a") == sorted([("linked", "r1", 4, 0, True), ("linked", "r1", 4, 0, False), *[("more_result", x, 4, 0, False) for x in ("r1", "r2", None)]], key=str)
    assert of("b") == [("no_result", None, 0, 1, True)] and of("lost") == [("no_call", x, 2, None, False) for x in "xy"]
    assert of(None) == sorted([("no_result", None, 0, None, True), ("no_call", "n", 1, None, False), ("no_call", "n", 1, None, False), ("no_call", None, 1, None, False)], key=str)
    assert sorted(r[1] for r in of("hot")) == sorted(f"h{i}" for i in range(3000)) and {(r[0], r[2], r[3]) for r in of("hot")} == {("linked", 3000, 2), ("more_result", 3000, 2)}
    assert len(got) == len(calls) + 3 + 2 + 3 + 2999


def test_tool_calls_cover_all_turns(spark, tmp_path):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "tool", "t"), (1, 4, "User", "v"), (2, None, None, None), (None, 3, "system", "\u00e9"), (2, 1, "assistant", "b"), (None, 1, "assistant", "c"), (None, 2, "user", "w"), (1, 2, "assistant", "again")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = tool_calls.op7_tool_calls(spark, str(tmp_path)).collect()
    assert collections.Counter(r["status"] for r in got) == {"other_role": 5, "linked": 1, "more_result": 1, "no_call": 2, "no_result": 1}
    assert len(got) == len(turns) - 1  # one answer stands in the row of its question
    sha = {(r["conv_id"], r["turn"]): r["message_sha256"] for r in got if r["status"] == "other_role"}
    assert set(sha) == {(1, 0), (1, 3), (1, 4), (2, None), (None, 3)}
    assert sha[None, 3] == hashlib.sha256('{"conv_id":null,"role":"system","text":"\u00e9","turn":3}'.encode()).hexdigest()


def test_number_of_mined_rules_changes_no_result(spark):
    # Words that always stand together: ties in confidence and support, of other verdicts too, and longer rules that equal shorter ones.
    rules = (("a.com", "/p/", "allow"), ("b.com", "/q/", "block"))
    urls = ["http://a.com/p/a/b/c?z=1"] * 6 + ["http://b.com/q/d/e?y=1"] * 6 + ["http://c.com/a/d/b/e/c?z=1&y=1", "http://c.com/a/d", "http://c.com/d/e/c", "http://c.com/b/q/p", "http://c.com/none"] * 3
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    a = as_dict(url_rules.url_filter(pages, rules=rules), "page_id")
    before, url_rules.INLINE_RULES = url_rules.INLINE_RULES, 0
    try:
        b = as_dict(url_rules.url_filter(pages, rules=rules), "page_id")
    finally:
        url_rules.INLINE_RULES = before
    assert {k: (r["verdict"], r["mined"]) for k, r in a.items()} == {k: (r["verdict"], r["mined"]) for k, r in b.items()}
    assert {"allow", "block"} <= {r["verdict"] for r in a.values() if r["mined"]}


def test_rare_toxic_words_are_features_among_many_common_ones(spark):
    common = " ".join(f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "uvwxyz")
    rows = [(i, common + (" " + ("scumbag" if i % 8 == 0 else "moron") if i % 4 == 0 else "")) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    keys, w = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), n_features=7)
    assert set(keys) == set(toxicity.features("scumbag moron")) and len(w) == len(keys) + 1


def test_odd_arguments_of_tool_calls_are_errors(spark):
    deep = "[" * 3000 + "]" * 3000
    odd = ["1e999", "NaN", deep, "[" * 250 + "]" * 250, '{"a":', None, '{"a": "\\ud800"}', '{"a": 1}']
    calls = spark.createDataFrame([(f"c{i}", None, "f", a) for i, a in enumerate(odd)] + [("t", None, "typed", "1"), ("p", None, "patterned", '"x"')], "call_id string, parent_id string, name string, arguments string")
    results = spark.createDataFrame([], "call_id string, content string")
    got = as_dict(tool_calls.link_tool_calls(calls, results, {"f": {}, "typed": {"type": "odd"}, "patterned": {"pattern": "("}}), "call_id")
    errors = ["$: no JSON", "$: no JSON", "$: nested too deep", "$: nested too deep", "$: no JSON", "$: no JSON", "", ""]
    assert [got[f"c{i}"]["errors"] for i in range(len(odd))] == errors
    assert json.loads(got["c0"]["message"])["arguments"] == "1e999" and json.loads(got["c6"]["message"])["arguments"] == {"a": "\ufffd"}
    assert got["t"]["errors"] == "$: schema has no type odd" and got["p"]["errors"] == "$: schema has no valid pattern" and not got["t"]["valid"]


def test_components_by_stars_are_those_of_one_task(spark):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(900, 1000)]
    table = spark.createDataFrame(links, "u long, v long").repartition(5)
    one, many = (sorted(map(tuple, near_dups.components(table, n).select("node", "root").collect())) for n in (1 << 20, 1))
    root = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in links:
        for u, v in links:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    assert one == many == sorted(root.items())
