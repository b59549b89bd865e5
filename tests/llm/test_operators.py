"""Each operator against brute force, and on nulls, empty and long texts, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from emberlog.llm import ann_tree, bpe_chunks, chat_format, decontaminate, graph, minhash_dedup, pii_surrogates, pretokens, quality, queries, suffix_dedup, url_filter, wavelet_shards

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(40_000))
#: Nulls, empty texts, white space, a very long text, repeated rows, equal texts, columns named like the operators' own.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one two"), (6, "one two"), (6, "one two"), (None, "one two"), (None, None), (7, "ONE two"), (8, "naïve ω 😀 it's")]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, 1, "x", 0.5, "k", 2) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, _id int, kept string, score double, text_key string, _found int")


@pytest.fixture(scope="module")
def nothing(edges):
    return edges.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1


def brute_neighbours(vectors, top=20, every=20):
    fine = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for k, (i, q) in enumerate(fine):
        if i % every == 0:
            near = sorted((-float((q * v).sum()), j) for n, (j, v) in enumerate(fine) if n != k)[:top]
            out.setdefault(i, []).append([(j, -s) for s, j in near])
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(700)]
    vectors += [(700 + i, vectors[0][1]) for i in range(60)] + [(None, vectors[1][1]), (900, None), (920, [0.0] * 6), (940, [float("nan")] * 6), (960, [None] + [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 9) for i, v in vectors], "vec_id long, embedding array<double>, leaf int")
    want, got = brute_neighbours(vectors), collections.defaultdict(list)
    for r in ann_tree.search(df, leaf=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(want)
    found = 0
    for q, near in got.items():
        assert [k for _, _, k in near] == list(range(1, 21)) and q not in [i for i, _, _ in near]
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        found += len({i for i, _, _ in near} & {i for i, _ in want[q][0]})
    assert found / (20 * len(want)) >= 0.9
    assert [i for i, _, _ in got[0]][:20] == list(range(700, 720))  # ties go to the smaller id
    short = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(50)] + [(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    both = ann_tree.search(short.unionByName(df.where("vec_id < 30").select("vec_id", "embedding"))).collect()
    of_short = [(r["rank"], r["vec_id"]) for r in both if r["query_id"] == 40]
    assert of_short == [(k + 1, j) for k, j in enumerate([j for j in range(49, 28, -1) if j != 40][:20])]  # each length is a collection
    few = df.where("vec_id < 4")
    assert [(r["rank"], r["vec_id"]) for r in ann_tree.search(few).orderBy("rank").collect()] == [(k + 1, j) for k, (j, _) in enumerate(brute_neighbours(vectors[:4])[0][0])]
    assert ann_tree.search(df.where("false")).count() == 0


def test_recall_on_the_table(spark):
    """The result's recall on a whole table, with many leaves."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None) for r in vectors.collect()]
    want, found = brute_neighbours(rows), 0
    for r in ann_tree.search(vectors, leaf=32).collect():
        found += any(r["vec_id"] == i for i, _ in want[r["query_id"]][0])
    assert found >= 0.9 * sum(len(x[0]) for x in want.values())


def test_samples_of_huge_tables(spark):
    """A share far below 2**-20 still takes its part: here by 62 bits, of ids that are dense enough."""
    ids = spark.range(1 << 22).toDF("entry")
    assert 1 <= ann_tree.sampled(ids, "entry", 8 / (1 << 22)).count() <= 40 and ann_tree.sampled(ids, "entry", 1.0).count() == 1 << 22


# 2


def brute_removed(texts, length):
    raws = [t.encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), len(r) - len(rest), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize(("many", "together"), [(2048, 4096), (1, 4096), (2048, 3), (2048, 1), (1, 2)])
def test_substrings(spark, many, together):
    rng = random.Random(many)
    parts = ["".join(rng.choice("abcé ") for _ in range(90)) for _ in range(6)]
    own = ["".join(rng.choice([*parts, "xyz", "q"]) for _ in range(rng.randint(0, 9))) for _ in range(40)] + ["a" * 500, "ab" * 300, "", "a" * 39]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removed(df, 40, 16, many, together).collect()}
    assert [got[i] for i in range(len(own))] == brute_removed(own, 40)


def test_substrings_of_the_table(docs, texts):
    want = dict(zip(texts, brute_removed(texts.values(), 200)))
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.removed(docs).collect()} == want


def test_substring_edges(edges, nothing):
    got = sorted(tuple(r)[1:] for r in suffix_dedup.removed(edges).collect())
    assert got == sorted(brute_removed([t or "" for _, t in EDGES], 200)) and suffix_dedup.removed(nothing).count() == 0


# 3


def test_quality(spark, docs, texts, edges, nothing):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(got) == len(texts) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [i for i in known if got[i]["held_out"]]
    right = sum(got[i]["predicted"] == known[i] for i in held) / len(held)
    assert right > max(0.85, sum(known[i] for i in held) / len(held))
    assert quality.score(edges, model).count() == len(EDGES) and quality.score(nothing, model).count() == 0
    kept = quality.keep_good(edges, model)
    assert kept.columns == edges.columns
    assert quality.fit(nothing, labels).scores(["x"])[0] == 0.5 and quality.train(["a", "b"], [1, 1]).scores(["c"])[0] > 0.9
    both = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, quality int")
    assert quality.fit(edges, both).scores([""])[0] == 0.5


# 4


def swapped(spark, *own):
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    return [r["text"] for r in pii_surrogates.surrogates(df).orderBy("doc_id").collect()]


def test_surrogates(spark):
    entities = ["anna.lee@mail7.example.com", "+1 (017) 555-7713", "4785380592391139", "123-45-6789", "97.51.17.173", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "DE89 3704 0044 0532 0130 00"]
    once = swapped(spark, *(f"a {e}, b" for e in entities), " / ".join(entities), None, "", "nothing here 12 3.4")
    alone = [t[2:-3] for t in once[: len(entities)]]
    assert once[len(entities)] == " / ".join(alone) and once[-3:] == [None, "", "nothing here 12 3.4"]  # the same everywhere
    for e, s in zip(entities, alone):
        assert s != e and e not in s
        if "." not in e:
            assert len(s) == len(e) and all(a.isdigit() == b.isdigit() or e[0] == "2" for a, b in zip(e, s)) and [c for c in s if not c.isalnum()] == [c for c in e if not c.isalnum()]
    assert alone[0].endswith(".example") and alone[4].count(".") == 3 and all(int(x) < 256 for x in alone[4].split("."))
    assert alone[1].startswith("+1 (") and alone[6].startswith("DE")
    names = swapped(spark, "Mrs Anna Lee and Mr Lee met Mr. Karl Anna.", "Г-н г-н Иван Петров, κ Νίκος Παππάς", "Mrs ANNA LEE")
    a = names[0].split()
    assert a[0] == "Mrs" and a[1].endswith("lina") and a[2] == a[5] and a[8].endswith("rik") and "Lee" not in names[0]
    assert all("Ѐ" <= c <= "ӿ" for c in names[1].split()[2]) and names[2].isupper() is False and names[2].split()[1] == a[1].upper()


def test_surrogates_are_distinct(spark):
    cards = [f"{i:016d}" for i in range(0, 4000)]
    ips = [f"10.0.{i // 250}.{i % 250}" for i in range(1000)]
    people = [f"Mr {chr(65 + i // 26)}{chr(97 + i % 26)}{'bcd'[j]}o Zu" for i in range(26 * 26) for j in range(3)]
    for own in (cards, ips, people):
        assert len(set(swapped(spark, *own))) == len(own)


def test_surrogate_edges(edges, nothing):
    out = pii_surrogates.replaced(edges)
    assert out.columns == edges.columns and rows_of(out) == rows_of(edges) and pii_surrogates.surrogates(nothing).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_surrogates_leave_nothing(spark):
    """Letters of all scripts, later mentions of names, phones in pairs, IPv6; true check digits; what only looks like data."""
    own = ["李明@例子.com", "ŁŁĄĘ@x.pl", "किरण@दफ्तर.in", "محمد@بريد.sa", "𐍈𐍉@x.org", "Ülkü.Şahin@posta.com.tr", "αλέξης@ταχυδρομείο.gr"]
    names = ["Mrs Anna Lee came. Anna Lee left, Lee's bag; Anna, LEEWAY. Mr Łukasz Żak met Żak and Dr Lee.", "Anna Lee left"]
    numbers = ["+33 6 12 34 56 78", "06 12 34 56 78", "fe80::1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00"]
    same = ["number 4111111111111112 here", "version 1.2.3.4 is out", "std::vector at 12:30:45", "Anna Lee"]
    got = swapped(spark, *own, *names, *numbers, *same)
    for entity, new in zip(own, got):
        name, host = entity.split("@")
        assert new.count("@") == 1 and new.endswith(".example") and name not in new and host not in new
    assert not set("李明例子") & set(got[0]) and len(got[0].split("@")[0]) == 2 and len(got[1].split("@")[0]) == 4
    text, alone = got[len(own) : len(own) + 2]
    assert not any(x in text for x in ("Anna", "Lee", "Żak", "Łukasz")) and "LEEWAY" in text and alone == "Anna Lee left"
    first, last = text.split()[1:3]
    last = last.rstrip(".")
    assert text.count(first) == 3 and text.count(last) == 4 and f"{last}'s bag" in text
    *phones, card, iban, bad = got[len(own) + 2 : len(own) + 9]
    assert phones[0].startswith("+33 ") and not set(phones) & set(numbers) and [len(x) for x in phones] == [len(x) for x in numbers[:4]]
    luhn = lambda x: sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(x))) % 10
    assert card != numbers[4] and luhn(card.replace(" ", "")) == 0
    mod = lambda x: int("".join(str(int(c, 36)) for c in x.replace(" ", "")[4:] + x[:4])) % 97
    assert mod(iban) == 1 and mod(bad) != 1 and iban[:2] == "DE" and iban[5:] == bad[5:] and iban[2:4] != bad[2:4]
    assert got[-4:] == same


def test_surrogates_of_the_table(spark):
    """Against a search by another engine: what isn't an entity stays, equal ones become equal, distinct ones distinct."""
    import regex

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    new, shape = {r["doc_id"]: r for r in pii_surrogates.surrogates(rows).collect()}, regex.compile(pii_surrogates.PATTERN)
    seen, n = {}, 0
    for doc_id, text in ((r["doc_id"], r["text"]) for r in rows.collect()):
        places, at, out = [m.span() for m in shape.finditer(text)], 0, new[doc_id]["text"]
        for a, b in places:
            assert out[at : at + a - (places[places.index((a, b)) - 1][1] if places.index((a, b)) else 0)] == text[(places[places.index((a, b)) - 1][1] if places.index((a, b)) else 0) : a]
            at += a - (places[places.index((a, b)) - 1][1] if places.index((a, b)) else 0)
            size = b - a + (8 if "@" in text[a:b] else 0)
            got = out[at : at + size]
            if "." in got and "@" not in got:  # an address may get longer or shorter
                got = regex.match(r"[0-9.]*[0-9]", out[at:]).group() if regex.fullmatch(r"[0-9.]+", text[a:b]) else got
                size = len(got)
            assert seen.setdefault(text[a:b], got) == got
            at, n = at + size, n + (got != text[a:b])
        assert out[at:] == text[places[-1][1] if places else 0 :]
    assert n > 30 and len(set(seen.values())) == len(seen) and sum(r["n_entities"] for r in new.values()) == n
    assert pii_surrogates.clashes(rows).count() == 0


def test_no_clashes(spark):
    names = [f"{a}{b}{c}{end}" for a in "BK" for b in "ae" for c in "ns" for end in ("", "a", "lina", "son", "rik")]
    rows = [(k, f"Mrs {x} Lee, Mr {x} Lee, Dr {x}; {x.lower()}@mail.com, 4{k:015d}, +1 (017) 555-{k:04d}") for k, x in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii_surrogates.clashes(df).count() == 0 and pii_surrogates.clashes(df.where("false")).count() == 0
    nulls = df.selectExpr("doc_id", "cast(null as string) as text")
    twice = [r["text"] for r in pii_surrogates.surrogates(df.union(df).union(nulls)).collect() if r["text"]]
    assert collections.Counter(collections.Counter(twice).values()) == {2: len(names)}
    long = " ".join(t for _, t in rows) * 8
    (got,) = pii_surrogates.surrogates(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert got["n_entities"] >= 8 * 40 * 5 and "mail.com" not in got["text"]


# 5


@pytest.fixture(scope="module")
def bpe():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_row(bpe, text):
    ids = bpe.encode_ordinary(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_bpe(spark, docs, texts, edges, nothing, bpe):
    own = queries.tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    assert {r[0]: tuple(r)[1:] for r in bpe_chunks.digests(docs, *own).collect()} == {i: bpe_row(bpe, t) for i, t in texts.items()}
    assert sorted(tuple(r)[1:] for r in bpe_chunks.digests(edges, *own).collect()) == sorted(bpe_row(bpe, t or "") for _, t in EDGES)
    assert bpe_chunks.digests(nothing, *own).count() == 0
    back = bpe_chunks.decode(bpe_chunks.encode(edges, *own), *own)
    assert sorted(bytes(r["raw"]) for r in back.collect()) == sorted((t or "").encode() for _, t in EDGES)


@pytest.mark.parametrize("text", ["don't we'll they've " * 40, " " * 300 + "a" * 300 + "\n" * 120, "1234567890" * 60, "é😀 ω'll\u3000\u00a0x  y\n\n z" * 30, "'" * 200 + "llll"])
def test_bpe_chunks_meet(text, bpe):
    path = queries.tokenizer("byte_bpe_multi_50k.tiktoken")
    for chunk, overlap in ((16, 4), (33, 8), (64, 2)):
        assert bpe_chunks.encode_text(text, path, public_tokenizers.PATTERN, chunk, overlap) == bpe.encode_ordinary(text)


# 6


def test_wavelet():
    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.integers(0, 50, n).astype(np.uint32)
        own, _, _ = wavelet_shards.unpack(wavelet_shards.pack(wavelet_shards.WaveletMatrix.build(ids), [], np.zeros(0)))
        assert (own.all() == ids).all() and (own.access(np.arange(n)) == ids).all()
        for symbol in (0, 7, 49, 50, 70000):
            places = np.flatnonzero(ids == symbol).tolist()
            assert own.count(symbol) == len(places) and own.occurrences(symbol) == places and own.select(symbol, len(places)) == -1
            assert own.rank(symbol, n // 2) == sum(p < n // 2 for p in places)


def library_rows(pairs):
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json")), [], 0
    for i, t in pairs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_shards(docs, texts, edges, nothing):
    path = queries.tokenizer("byte_bpe_50k.json")
    assert rows_of(wavelet_shards.digests(docs, path, shard_bytes=50_000)) == sorted(library_rows(sorted(texts.items())), key=repr)
    order = sorted(EDGES, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    assert rows_of(wavelet_shards.digests(edges, path)) == sorted(library_rows(order), key=repr)
    assert wavelet_shards.digests(nothing, path).count() == 0


def test_shards_with_added_tokens(spark, monkeypatch):
    """Texts that hold the special token's string, long ones, and a worker that forgets what it kept."""
    rng = random.Random(9)
    parts = ["<|endoftext|>", "<|endoftext", " a", "word", " naïve", "\n\n", "1234", " 's", "'s", "ω😀", "  ", " Ġ"]
    own = [(k, "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 40, 4000])))) for k in range(80)]
    df = spark.createDataFrame(own, "doc_id long, text string")
    path = queries.tokenizer("byte_bpe_50k.json")
    assert rows_of(wavelet_shards.digests(df, path)) == sorted(library_rows(own), key=repr)
    encoder = wavelet_shards.PretokenEncoder(path)
    monkeypatch.setattr(wavelet_shards, "KEPT", 3)
    for k in range(0, 80, 10):
        ids, starts = encoder.encode([t for _, t in own[k : k + 10]])
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [wavelet_shards.tokenizer(path).encode(t, add_special_tokens=False).ids for _, t in own[k : k + 10]]


def test_pretokens():
    import regex

    rng = random.Random(1)
    for _ in range(300):
        own = ["".join(rng.choice("ab'slt rev 1²\n\t\u00a0é!?ω") for _ in range(rng.randint(0, 25))) for _ in range(3)]
        cp, starts = pretokens.code_points(own)
        want = [a + m.start() for t, a in zip(own, starts.tolist()) for m in regex.finditer(public_tokenizers.PATTERN, t)]
        assert pretokens.pretoken_starts(cp, starts).tolist() == want


# 7


def test_chat(spark):
    probe = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a\\b<s>\\"), (2, 0, "assistant", probe), (2, 1, None, "x<<TEXT>>"), (2, 1, "tool<</ROLE>>", "é😀"), (None, None, "user", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    done = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert [(t["role"], t["text"], t["loss"]) for t in done[1]["turns"]] == [("system", "s", False), ("user", "", False), ("assistant", "a\\b<s>\\", True)]
    assert [(t["role"], t["text"]) for t in done[2]["turns"]] == [("assistant", probe), ("", "x<<TEXT>>"), ("tool<</ROLE>>", "é😀")]
    assert (done[1]["valid"], done[1]["broken_at"]) == (True, None) and (done[2]["valid"], done[2]["broken_at"]) == (False, 0) and not done[None]["valid"]
    got = {r["conv_id"]: r for r in chat_format.digests(df).collect()}
    assert got[1]["loss_chars"] == 7 and got[1]["loss_sha256"] == hashlib.sha256(b"a\\b<s>\\").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(f"assistant\n{probe}\n\nx<<TEXT>>\ntool<</ROLE>>\né😀\n".encode()).hexdigest()
    twice = {r["conv_id"]: r for r in chat_format.digests(df.union(df).selectExpr("conv_id", "turn", "role", "repeat(text, 20000) as text")).collect()}
    assert twice[1]["n_turns"] == 6 and twice[1]["loss_sha256"] == hashlib.sha256(b"a\\b<s>\\" * 40000).hexdigest()
    assert chat_format.digests(df.where("false")).count() == 0
    assert "Python" not in chat_format.digests(df)._jdf.queryExecution().executedPlan().toString()


# 8


def plain_distance(pattern, text):
    last = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != t)))
        last = row
    return min(last)


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(150):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, n))) for n in (12, 30))
        assert decontaminate.edit_distance(a, b) == plain_distance(a, b)


def test_decontamination(spark, edges, nothing):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 50)))) for i in range(25)] + [(90, None), (91, "?!"), (0, None)]
    own, want = [], set()
    for k in range(150):
        around = [" ".join(word() for _ in range(60)) for _ in range(2)]
        item, parts = k % 25, items[k % 25][1].split()
        for _ in range((k // 25) % 3):
            parts[rng.randrange(len(parts))] += rng.choice("xyz")  # small edits
        if k % 2:
            want.add((k, item))
            around.insert(1, " ".join(parts).upper().replace(" ", ",  "))
        own.append((k, " ".join(around), 1))
    df = spark.createDataFrame(own, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edit_distance"] for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == want
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(df, bench).collect()) == [k for k in range(150) if k % 2 == 0]
    assert decontaminate.contaminated(edges, bench).count() == 0 and decontaminate.keep_clean(edges, bench).columns == edges.columns
    assert rows_of(decontaminate.keep_clean(edges, bench)) == rows_of(edges) and decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0 and rows_of(decontaminate.keep_clean(df, bench.where("false"))) == rows_of(df)
    short = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in decontaminate.contaminated(edges, short).collect()) == ["5", "6", "6", "7", "None"]


@pytest.mark.parametrize("size", [32, 48, 64, 96, 128, 256, 300])
def test_recall_of_edited_words(size):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    own = [[word() for _ in range(size)] for _ in range(40)]
    items, found = decontaminate.Items.build([(k, " ".join(x)) for k, x in enumerate(own)]), 0
    for share in (0.2, 0.25, 0.3):
        texts = []
        for x in own:
            edited = set(rng.sample(range(size), int(share * size)))
            texts.append(" ".join([word() for _ in range(30)] + [word() if k in edited else w for k, w in enumerate(x)] + [word() for _ in range(30)]))
        found += sum(text == item for text, item, _ in decontaminate.leaks(texts, items, 0.4))
    assert found >= 0.98 * 3 * len(own)


@pytest.mark.parametrize("size", [1, 3, 5, 12, 25, 50, 120, 300])
def test_recall_of_spread_edits(size):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 8)))
    own = [[word() for _ in range(size)] for _ in range(30)]
    items, found, want = decontaminate.Items.build([(k, " ".join(x)) for k, x in enumerate(own)]), 0, 0
    for every in (1, 2, 3):  # one letter in each, each second and each third word
        texts = []
        for x in own:
            edited = []
            for k, w in enumerate(x):
                at = rng.randrange(len(w))
                edited.append(w if k % every else w[:at] + rng.choice("uvwxyz") + w[at + 1 :])
            texts.append(" ".join([word() for _ in range(30)] + edited + [word() for _ in range(30)]))
        leaked = {(k, k) for k, (x, t) in enumerate(zip(own, texts)) if decontaminate.edit_distance(" ".join(x), t) <= 0.2 * len(" ".join(x))}
        want += len(leaked)
        found += len(leaked & {(t, i) for t, i, _ in decontaminate.leaks(texts, items)})
    assert want and found >= 0.98 * want


def edited(rng, text, share):
    out = list(text)
    for at in sorted(rng.sample(range(len(text)), int(share * len(text))), reverse=True):
        out[at : at + 1] = {0: [rng.choice("abcdefgh ")], 1: [], 2: [out[at], rng.choice("abcdefgh ")]}[rng.randrange(3)]
    return "".join(out)


@pytest.mark.parametrize("how", [0.0, 0.05, 0.1, 0.2, "typo 3", "typo 2", "split 4", "split 2"])
def test_decontamination_recall(spark, how):
    """Against brute force, on the table's own items with edits planted between its documents' texts."""
    rng = random.Random(str(how))
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()
    around = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()]
    items, found, want = decontaminate.Items.build([tuple(r) for r in bench]), 0, 0
    for k, text in enumerate(items.texts[:120]):
        if isinstance(how, float):
            own = edited(rng, text, how)
        else:
            what, every = how.split()
            own = text.split()
            for i in range(0, len(own), int(every)):
                at = rng.randrange(1, max(2, len(own[i])))
                own[i] = own[i][: at - 1] + "q" + own[i][at:] if what == "typo" else f"{own[i][:at]} {own[i][at:]}"
            own = " ".join(own)
        if decontaminate.edit_distance(text, decontaminate.normalized([own])[0]) <= 0.2 * len(text):
            want += 1
            found += any(i == k for _, i, _ in decontaminate.leaks([f"{rng.choice(around)} {own} {rng.choice(around)}"], items))
    assert want >= 100 and found >= 0.95 * want


def test_decontamination_against_all_pairs(spark):
    """Every pair of a text and an item, with items of 2 to 90 words, long ones among them, and passes of few items."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    bench = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([2, 3, 5, 8, 12, 20, 40, 90, 300])]
    own = [" ".join([word() for _ in range(20)] + [edited(rng, bench[k % 9][1], rng.choice([0, 0.1, 0.19]))] * (k % 3 > 0) + [word() for _ in range(20)]) for k in range(60)]
    want = set()
    for k, text in enumerate(own):
        plain = decontaminate.normalized([text])[0]
        for i, item in bench:
            n = decontaminate.edit_distance(item, plain)
            if n <= 0.2 * len(item):
                want.add((k, i, n))
    docs, items = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {tuple(r)[:3] for r in decontaminate.contaminated(docs, items).collect()}
    assert {x[:2] for x in got} <= {x[:2] for x in want} and len(got & want) >= 0.95 * len(want)


def test_decontamination_passes(spark, monkeypatch):
    """Bounds that are lowered give the same rows."""
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    want = rows_of(decontaminate.contaminated(docs, bench))
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 3000)
    assert want and rows_of(decontaminate.contaminated(docs, bench)) == want and decontaminate.keep_clean(docs, bench).count() == docs.count() - len({r[0] for r in want})


# 9


def brute_components(pairs, words, percent):
    def shingles(text):
        w = (text or "").encode().translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256))).split(None)
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()

    sets, root = [shingles(t) for _, t in pairs], list(range(len(pairs)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    return sets, [find(k) for k in range(len(sets))]


def test_near_duplicates(spark, docs, texts):
    rng, pairs = random.Random(8), []
    for k in range(60):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 1, 2, 5, 60, 60, 200]))]
        for _ in range(rng.randint(1, 5)):
            pairs.append((len(pairs), " ".join(w if rng.random() > 0.01 else "z" for w in base)))
    for own in (pairs, sorted(texts.items())):
        df = spark.createDataFrame(own, "doc_id long, text string")
        sets, roots = brute_components(own, 3, 85)
        least = {r: min(own[k][0] for k in range(len(own)) if roots[k] == r) for r in set(roots)}
        want = sorted((i, len(s), least[r], least[r] == i) for (i, _), s, r in zip(own, sets, roots))
        assert sorted(map(tuple, minhash_dedup.near_duplicates(df, 3, 85, bands=40, rows=8).collect())) == want
        kept = minhash_dedup.keep_one(df, 3, 85, bands=40, rows=8)
        assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, _, k in want if k]


def test_near_duplicate_blocks(spark, monkeypatch):
    """A cluster dealt into many blocks gives the same components."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", 300)
    base = [f"w{i}" for i in range(100)]
    own = [(k, " ".join(base[:k] + ["z"] + base[k + 1 :])) for k in range(40)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(own, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_near_duplicate_edges(edges, nothing):
    got = rows_of(minhash_dedup.near_duplicates(edges))
    n = 40_000 * 2 - 4
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, n, 4, True), (5, 1, 5, True), (6, 1, 5, False), (6, 1, 5, False), (None, 1, 5, False), (None, 0, None, True), (7, 1, 5, False), (8, 1, 8, True)], key=repr)
    assert minhash_dedup.near_duplicates(nothing).count() == 0 and minhash_dedup.keep_one(nothing).count() == 0
    kept = minhash_dedup.keep_one(edges)
    assert kept.columns == edges.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "8", "None"]
    six = minhash_dedup.keep_one(edges.where("doc_id = 6"))
    assert six.count() == 1  # of rows with one id and text, one stays


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 50)}}


# 10


def test_urls(spark):
    cases = {
        "https://a.ORG/x": ("a.org", "/x", "org/", "allow"), "http://example.org/es/1?casino": ("example.org", "/es/1", "example.org/es/", "block"),
        "http://www.example.org/en/1": ("www.example.org", "/en/1", "example.org/en/1", "block"), "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://b.com/fr/casino": ("b.com", "/fr/casino", "com/fr/", "allow"), "http://b.com/de/": ("b.com", "/de/", "com/de/", "block"), "http://borg/casino": ("borg", "/casino", None, "block"),
        "http://b.net/casinos": ("b.net", "/casinos", None, "allow"), "http://b.net/?Free=1&WIN": ("b.net", "/", None, "block"), "http://b.net/free-free": ("b.net", "/free-free", None, "allow"),
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme casino": ("", "", None, "block"), "x://h#a/b": ("h", "", None, "allow"), "x://://y": (":", "//y", None, "allow"),
    }
    df = spark.createDataFrame([(k, u, "z") for k, u in enumerate(cases)], "page_id long, url string, host string")
    got = [tuple(r)[1:5] for r in url_filter.judge(df).orderBy("page_id").collect()]
    assert got == list(cases.values()) and url_filter.judge(df.where("false")).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(cases)))
    assert sorted(con.sql(url_filter.sql()).fetchall()) == sorted(tuple(r) for r in url_filter.judge(df).collect())
