import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from railspoke.llm import canonical, mixing, term_frequency, tokenizer, truncation


# --- term frequencies ---


def brute_terms(rows):
    found, records = Counter(), {}
    for key, *values in rows:
        for field, v in zip(("surface", "highway"), values, strict=True):
            for t in re.findall(r"\w+", (v or "").lower()):
                found[field, t] += 1
                records.setdefault((field, t), set()).add(key)
    return {k: (n, len(records[k])) for k, n in found.items()}


def test_terms(spark):
    r = random.Random(2)
    words = ["asphalt", "Gravel", "a_b", "x;y", "Ümlaut é", "hot hot hot", None, "", "  ", "!!", "x" * 20000]
    rows = [(i, "hot" if r.random() < 0.4 else r.choice(words), r.choice(words)) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, surface string, highway string").withColumn("term", F.lit("clash"))
    got = term_frequency.term_frequencies(df, "row_id", ["surface", "highway"]).collect()
    assert {(x["tag_field"], x["term"]): (x["occurrences"], x["records"]) for x in got} == brute_terms(rows)
    marks = {(x["tag_field"], x["term"]): x["mark"] for x in term_frequency.useless_terms(df, "row_id", ["surface", "highway"]).collect()}
    assert marks["surface", "hot"] == "common" and set(marks.values()) <= {"common", "rare"}
    assert term_frequency.useless_terms(df.limit(0), "row_id", ["surface"]).count() == 0


def test_marks_and_repeated_rows(spark):
    rows = [(1, "a a"), (1, "a a"), (2, "b")] + [(k, "c") for k in range(3, 100)] + [(200, None)]
    df = spark.createDataFrame(rows, "row_id long, surface string")
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in term_frequency.marked_frequencies(df, "row_id", ["surface"]).collect()}
    assert got == {"a": (4, 1, "rare"), "b": (1, 1, "rare"), "c": (97, 97, "common")}
    assert term_frequency.top_terms(df, "row_id", ["surface"], 1).collect()[0]["term"] == "c"
    assert term_frequency.frequency_spectrum(df, "row_id", ["surface"]).count() == 2


def test_terms_of_rows_without_id_and_of_long_values(spark):
    long = " ".join(f"t{k}" for k in range(30_000)) + " t0"
    rows = [(None, "a"), (None, "a b"), (1, "a"), (2, long)]
    df = spark.createDataFrame(rows, "row_id long, surface string")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_frequency.term_frequencies(df, "row_id", ["surface"]).collect()}
    assert got["a"] == (3, 2) and got["b"] == (1, 1) and got["t0"] == (2, 1) and len(got) == 30_002


# --- canonical values ---

REFERENCE = [
    ("surface", "asphalt", "Asphalt"), ("surface", "asphalt:lanes", "Asphaltspuren"), ("surface", "paving_stones", "Pflastersteine"),
    ("surface", "gravel", "Schotter"), ("surface", "sett", "Kleinpflaster"), ("highway", "living_street", "Spielstrasse"), ("highway", "path", "Pfad"),
]


def osa(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_distances():
    r = random.Random(1)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(150)}
    trie = canonical.Trie([(w, w) for w in words])
    for _ in range(200):
        q = "".join(r.choice("abcd") for _ in range(r.randint(1, 7)))
        for k in (0, 1, 2, 3):
            assert {(e, c) for e, _, c in trie.within(q, k)} == {(osa(q, w), w) for w in words if osa(q, w) <= k}


@pytest.mark.parametrize("slice_rows", [100, 2])
def test_mapping(spark, slice_rows):
    cases = {
        "ASPHALT": "asphalt", "asphlat": "asphalt", "surface=asphalt": "asphalt", "asphalt (alt)": "asphalt", '"asphalt, old"': "asphalt",
        "old asphalt": "asphalt", "asphalt?": "asphalt", "asphalt;": "asphalt", "аsphаlt": "asphalt", "Paving Stones": "paving_stones",
        "pflast.": "paving_stones", "schoter": "gravel", "seet": "sett", "note 12345678": "unmatched", "weiss nicht": "unmatched",
        "k.A.": "unmatched", "x" * 50_000: "unmatched",
    }
    none = [None, "", " \xa0", "asphalt", "gravel;sett"]
    rows = [(i, v, None, "c") for i, v in enumerate([*cases, *none])] + [(0, "ASPHALT", None, "c"), (900, None, "Living-Street", "c")]
    rows += [(None, "schoter", None, "c"), (901, "frisch asphalt", None, "c")]
    df = spark.createDataFrame(rows, "row_id long, surface string, highway string, canonical string")
    ref = spark.createDataFrame(REFERENCE, "tag_field string, canonical string, label_de string")
    how = {"slice_rows": slice_rows, "remarks": [*canonical.REMARKS, "frisch"], "block_values": 7}
    got = [(r["row_id"], r["canonical"]) for r in canonical.map_to_canonical(df, "row_id", ["surface", "highway"], ref, **how).collect()]
    want = [*enumerate(cases.values()), (0, "asphalt"), (900, "living_street"), (901, "asphalt"), (None, "gravel")]
    assert Counter(got) == Counter(want)
    empty = canonical.map_to_canonical(df.where("row_id = 0"), "row_id", ["surface"], ref.limit(0))
    assert [r["canonical"] for r in empty.collect()] == ["unmatched"] * 2


# --- tokenizer ---


@pytest.fixture(scope="module")
def bpe():
    with open(tokenizer.default_path(), "rb") as f:
        return tokenizer.ByteBPE(f.read())


def test_same_as_the_library(bpe):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(0)
    texts = ["".join(r.choice("ab cdeéüÄ漢😀́\x1c\x85 \n\t0²½'s<|>") for _ in range(r.randint(0, 300))) for _ in range(300)]
    texts += ["<|endoftext|>", "a" * 5000, "ab" * 3000, "一" * 1000, " " * 4000 + "x", "don't  stop\n\n "]
    for t in texts:
        want = own.encode_ordinary(t)
        assert bpe.encode(t) == want and bpe.count(t) == len(want)
        assert own.decode(bpe.encode(t)) == t
    data = "Wiederaufbaugesellschaft".encode()
    assert bpe.merge_short(data) == bpe.merge_long(data)


def test_corpus(spark, bpe):
    docs = spark.createDataFrame([(1, "Hallo Welt", "x"), (2, "", "x"), (3, None, "x"), (1, "Hallo Welt", "y")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokenizer.encode_corpus(docs).collect())
    assert got == [(1, bpe.encode("Hallo Welt"))] * 2 + [(2, []), (3, [])]
    assert tokenizer.token_counts(docs, ["doc_id"]).agg(F.sum("n_tokens")).collect()[0][0] == 2 * len(bpe.encode("Hallo Welt"))
    assert tokenizer.encode_corpus(docs.limit(0)).count() == 0


# --- mixing ---


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        for key in (1, 2, 99):
            p = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(p.tolist()) == list(range(n))
    a, b = (mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, k)).tolist() for k in (1, 2))
    assert a != b and a != sorted(a)


@pytest.fixture(scope="module")
def mixture(spark):
    r = random.Random(5)
    docs = [(i, " ".join(["wort"] * r.randint(1, 60)), r.choice(["big"] * 8 + ["small", "tiny", "none", None]), "x") for i in range(3000)]
    docs += [(9001, None, "big", "x"), (9002, "", "big", "x"), (9003, "lang " * 5000, "small", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, block string")
    targets = spark.createDataFrame(
        [("big", 0.5, 1), ("small", 0.4, 9), ("tiny", 0.1, 2), ("absent", 0.0, 3), ("odd", None, None)],
        "source string, target_share double, max_repeats int",
    )
    return df, targets, mixing.Mixture(df, targets, block_tokens=128, shards=7, total_tokens=60_000)


def test_shares_and_repeats(mixture):
    _, _, m = mixture
    report = {r["source"]: r for r in m.report().collect()}
    for name, share in (("big", 0.5), ("small", 0.4), ("tiny", 0.1)):
        r = report[name]
        assert r["target_tokens"] == round(60_000 * share)
        # short only where all repeats together hold too little
        assert r["reached_tokens"] == min(r["target_tokens"], r["max_repeats"] * r["source_tokens"])
        assert r["shortfall_tokens"] == r["target_tokens"] - r["reached_tokens"]
    assert report["big"]["shortfall_tokens"] == report["small"]["shortfall_tokens"] == 0
    assert report["absent"]["reached_tokens"] == 0 and report["odd"]["reached_tokens"] == 0 and "none" not in report
    pieces = m.blocks().collect()
    lengths = {(r["doc_id"]): r["n_tokens"] for r in m.sized.collect()}
    for name, most in (("big", 1), ("small", 9), ("tiny", 2)):
        own, used = [p for p in pieces if p["source"] == name], Counter()
        for p in own:
            assert 0 <= p["token_from"] < p["token_to"] <= lengths[p["doc_id"]]
            for t in range(p["token_from"], p["token_to"]):
                used[p["doc_id"], t] += 1
        assert max(used.values()) <= most and sum(used.values()) == report[name]["reached_tokens"]
        # all blocks are full but the source's last
        sizes = Counter()
        for p in own:
            sizes[p["slot"]] += p["token_to"] - p["token_from"]
        assert sorted(sizes.values())[1:] == [128] * (len(sizes) - 1)
    slots = {(p["source"], p["slot"], p["shard"]) for p in pieces}
    assert len({(s, k) for s, k, _ in slots}) == len(slots) and {x for *_, x in slots} == set(range(7))
    rows = m.selection().groupBy("doc_id", "use_no").count().where("count > 1")
    assert rows.isEmpty()


def test_streams_shorter_than_a_block(spark):
    docs = spark.createDataFrame([(1, "ein wort", "s"), (2, "und noch eins", "s")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 1.0, 50)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(docs, targets, block_tokens=64, shards=2, total_tokens=150)
    r = m.report().collect()[0]
    assert r["reached_tokens"] == 150 and r["most_uses"] == -(-150 // r["source_tokens"])
    short = mixing.Mixture(docs, targets.withColumn("max_repeats", F.lit(2)), block_tokens=64, shards=2, total_tokens=150).report().collect()[0]
    assert short["reached_tokens"] == 2 * r["source_tokens"] and short["shortfall_tokens"] == 150 - short["reached_tokens"] > 0


def test_more_slots_than_a_billion(spark):
    targets = spark.createDataFrame([("s", 1.0, 2_000_000_000)], "source string, target_share double, max_repeats int")
    docs = spark.createDataFrame([(1, "ein wort und noch eins", "s")], "doc_id long, text string, source string")
    m = mixing.Mixture(docs, targets, block_tokens=1, shards=4, total_tokens=5_000_000_000)
    made = mixing._slots(m.seed, [0], [m.plan[0][5]], ["s"], 4)
    import pyarrow as pa

    got = list(made([pa.record_batch([pa.array([0, 4_999_999_999])], names=["id"])]))[0].to_pydict()
    assert got["shard"] == [0, 3] and all(0 <= b < 5_000_000_000 for b in got["block"])


def test_same_seed_same_mix(mixture):
    df, targets, m = mixture
    again = mixing.Mixture(df, targets, block_tokens=128, shards=7, total_tokens=60_000)
    assert sorted(map(tuple, m.selection().collect())) == sorted(map(tuple, again.selection().collect()))


def test_empty_mixture(mixture):
    df, targets, _ = mixture
    assert mixing.Mixture(df.limit(0), targets).selection().count() == 0
    assert mixing.Mixture(df, targets.limit(0)).report().count() == 0


# --- truncation ---


@pytest.fixture(scope="module")
def posts(spark):
    r = random.Random(8)
    nouns = [f"{a}{b}" for a in ("Wald", "Stein", "Ober", "Sonn", "Moos") for b in ("bach", "kirch", "au", "loh", "heim")]
    forms = [
        "Der letzte Zug nach {n} fährt leider schon um {k} Uhr.", "Wir sind gestern bei {n} gestartet und nach {k} Kilometern angekommen.",
        "In {n} gibt es eine Bäckerei, die auch Schläuche verkauft.", "Meine Kette knarzt, sobald der Weg hinter {n} steil wird.",
    ]
    rows, cut = [], set()
    for i in range(3000):
        text = " ".join(r.choice(forms).format(n=r.choice(nouns), k=r.randint(2, 90)) for _ in range(r.randint(1, 5)))
        kind = r.random()
        if kind < 0.06:
            at = r.randrange(15, len(text) - 2)
            if text[at - 1] not in ". ":
                text, cut = text[:at], cut | {i}
        elif kind < 0.12:
            text = text[:-1]
        elif kind < 0.2:
            text += r.choice([" :)", "\n\nGruß\nradfuchs", "\n-- \nZwei Räder, ein Fahrplan", " ...", "\nhttp://pics.example/a/1.jpg"])
        rows.append((i, text, r.choice(["a", "a", "a", "b", None])))
    rows += [(5000, None, "a"), (5001, "", "a"), (5002, " \n", "a"), (5003, "[quote=x]Wir sind gest[/quote]\nGenau.", "a")]
    rows += [(5004, "Der letzte Zug nach Wald�", "a"), (5005, rows[0][1].rstrip(".") + "." + " x" * 50_000 + ".", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("why", F.lit(1)), cut | {5004}


def test_truncated(posts):
    docs, cut = posts
    got = [r["doc_id"] for r in truncation.truncated_texts(docs).collect()]
    assert len(got) == len(set(got))
    got = set(got)
    # texts cut right before their last mark cannot be told from those that lack it
    recall, precision = len(got & cut) / len(cut), len(got & cut) / len(got)
    assert recall > 0.9 and precision > 0.9, (recall, precision)
    assert not got & {5000, 5001, 5002, 5003, 5005} and 5004 in got


def test_endings_are_judged_by_their_counts(spark):
    """Texts that end in a mark, an opened bracket, a tag, a reference or a very long word."""
    long = "donau" + "dampf" * 30 + "schiff"
    whole = f"Heute war die Tour (klappt bei mir) schön, aber kurz &amp; nass.<br />\nDas {long} fuhr spät ab."
    ends = ["Heute war die Tour (klappt", "Heute war die Tour (", "Heute war die Tour (klappt bei mir) schön,", "schön, aber kurz &am"]
    ends += [f"{whole} Heute war die Tour (klappt bei mir) schön, aber kurz &amp; nass.<b", f"{whole}\nDas {long[:100]}", f"{whole}\nDas {long} fuhr sp\ufffd"]
    rows = [(i, whole, "a") for i in range(40)] + [(100 + i, e, "a") for i, e in enumerate(ends)] + [(200, whole + " :)", "a"), (201, f"{whole} {whole[:-1]}", "a")]
    got = {r["doc_id"]: r["why"] for r in truncation.truncated_texts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert set(got) == {100 + i for i in range(len(ends))}, got
    assert set(got.values()) <= {"trigram", "longer trigram", "class", "word", "unknown word", "mark", "place", "two words"}


def test_limit_of_a_field(spark):
    r = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "drei"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(5, 60))) + "." for _ in range(1500)]
    df = spark.createDataFrame([(i, t[:200], "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {x["doc_id"] for x in truncation.truncated_texts(df).collect()}
    cut = {i for i, t in enumerate(texts) if len(t) > 200}
    assert len(got & cut) / len(cut) > 0.95 and len(got - cut) < 20


def test_rates_and_empty(posts):
    docs, _ = posts
    rows = {r["source"]: r for r in truncation.truncation_rates(docs).collect()}
    assert rows["a"]["texts"] > rows["b"]["texts"] and 0 < rows["a"]["rate"] < 0.2
    assert truncation.truncated_texts(docs.limit(0)).count() == 0
