"""The operators on odd tables (nulls, empty and long texts, ties, repeated rows, no rows, clashing columns) and against brute force."""

import hashlib
import html as html_lib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import exact_dedup, html_text, jaccard_join, license_scan, mixing, quality_rules, sentence_piece, sharding, token_file, tool_chat

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} the and, of" for i in range(20_000))
BASE = "It is the case that all of these words and more of them stand in a row for the test of a near copy which has some words changed at one place only " * 3
ODD = [(1, "a  b\tc", "en", "src0"), (2, "a b c", "en", "src0"), (2, "a b c", "en", "src0"), (3, None, None, None), (4, "", "de", "src1"), (5, LONG, "xx", "else"), (None, "no id here", "en", "src0"), (6, BASE, "en", "src1"), (7, BASE.replace("test", "check", 1), "en", "src1"), (8, "\x00 \x1c é🙂 ▁  ", "fr", "src2")]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string")
    return d.withColumns({"shard": F.lit("x"), "n_words": F.lit("y"), "kept": F.lit(0), "row": F.lit(1), "id": F.lit(2), "epoch": F.lit(9), "w": F.lit(5), "score": F.lit("z")})


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_sharding(spark, odd):
    out = sharding.shard_by_size(odd, 4, F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.octet_length("text"), F.col("doc_id")).collect()
    assert len(out) == len(ODD) and {r.shard for r in out} <= set(range(4))
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.shard_by_size(odd.limit(0), 4, F.lit(1), F.lit(1), F.col("doc_id")).count() == 0
    found = sharding.op1_shards(spark, SF).toPandas()
    by = found.groupby("shard")["size"].sum()
    assert len(found) == 200 and by.max() - by.min() <= 2 * found["size"].max()


def test_licenses(spark, odd):
    out = {r.doc_id: r for r in license_scan.scan_licenses(odd).collect()}
    assert len(out) == 9 and out[3].n_words == 0 and out[3].labels == "" and out[1].first_word is None
    given = "See CC-BY 4.0, cc by\n\nThis program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."
    r = license_scan.scan_licenses(spark.createDataFrame([(1, given)], "doc_id bigint, text string")).first()
    assert (r.n_base, r.base_labels, r.first_word, r.score) == (3, "cc-by,gpl", 1, 1.0) and "gpl-notice" in r.labels
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0


def test_license_join_is_exact():
    frequency = {w: hash(w) % 50 for t in license_scan.TEMPLATES.values() for w in license_scan._words(t)}
    m = license_scan.Matcher(license_scan.TEMPLATES, 0.8, frequency)
    rng = np.random.default_rng(3)
    for label, t in license_scan.TEMPLATES.items():
        words = list(license_scan._words(t))
        for _ in range(30):
            block = [w for w in words if rng.random() < 0.85] + [b"other"] * 3
            wanted = {x: len(set(license_scan._words(y)) & set(block)) / len(set(license_scan._words(y))) for x, y in license_scan.TEMPLATES.items()}
            assert m.search(block) == pytest.approx({x: v for x, v in wanted.items() if v >= 0.8})


def test_sentencepiece(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_piece.model_path())
    out = sentence_piece.encode_texts(odd, sentence_piece.model_path()).select("doc_id", "ids", "parity").collect()
    wanted = sorted(str(sp.encode(t or "")) for _, t, *_ in ODD)
    assert sorted(str(list(r.ids)) for r in out) == wanted and all(r.parity for r in out)
    assert sentence_piece.encode_texts(odd.limit(0), sentence_piece.model_path()).count() == 0


def _measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd):
    d = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, (_, t, *_) in enumerate(ODD)], "doc_id bigint, text string"))
    for r in quality_rules.judged(d).collect():
        wanted = _measures(r.text)
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == wanted
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    judged = quality_rules.judged(d).cache()
    good = {r.doc_id for r in judged.collect() if r.kept}
    assert {r.doc_id for r in quality_rules.judged(d).filter("kept").collect()} == {r.doc_id for r in quality_rules.keep_good(d).collect()} == good
    assert quality_rules.judged(d).filter("n_words > 100").count() == sum(r.n_words > 100 for r in judged.collect())
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.judged(odd).count() == len(ODD) and quality_rules.judged(odd.limit(0)).count() == 0


def test_exact_dedup(spark, odd):
    out = exact_dedup.duplicate_report(odd).collect()
    assert len(out) == len(ODD)
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in out if r.id in (1, 2)) == [(1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False)]
    assert {(r.id, r.keep_id, r.group_size) for r in out if r.id in (3, 4)} == {(3, 3, 2), (4, 3, 2)}
    assert next(r for r in out if r.id == 3).sha == hashlib.sha256(b"").hexdigest()
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in out)
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "doc_id bigint, text string")
    assert sorted(map(tuple, exact_dedup.drop_duplicates(twice).collect())) == [(1, "x"), (2, "y")]
    assert exact_dedup.duplicate_report(odd.limit(0)).count() == 0
    digests = exact_dedup._digests(odd, F.col("text"), F.col("doc_id"))
    assert exact_dedup.lookup(exact_dedup.flush(digests), [hashlib.sha256(b"a b c").hexdigest()]).first().n == 3


def test_jaccard_join(spark, odd):
    out = {r.id: r for r in jaccard_join.near_duplicates(odd).collect()}
    assert out[6].class_id == out[7].class_id == 6 and out[6].n_links == 1 and out[3].class_id == 3 and out[None].class_id is None
    assert jaccard_join.near_duplicates(odd.limit(0)).count() == 0
    texts = dict(documents(spark).select("doc_id", "text").collect())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in texts.items()}
    links = {i: sum(j != i and bool(s) and len(s & z) >= 0.8 * len(s | z) for j, z in sets.items()) for i, s in sets.items()}
    assert {r.doc_id: r.n_links for r in jaccard_join.op6_jaccard_join(spark, SF).collect()} == links
    assert jaccard_join.keep_first(odd).columns == odd.columns


def test_jaccard_join_tells_rows_apart_by_text(spark):
    """Repeated ids, rows without one, copies of all kinds: nothing unrelated goes, and of each class one row stays."""
    base = " ".join(f"w{i}" for i in range(300))
    other = " ".join(f"v{i}" for i in range(100))
    rows = [(1, base), (2, base.replace("w150", "x")), (2, other), (None, base + " tail"), (None, "  "), (3, base.upper()), (3, base.upper()), (4, other), (None, None), (5, base), (1, base)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"Row": F.lit(7), "th": F.lit("x"), "key": F.lit(b"k")})
    out = Counter((r.id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(d).collect())
    assert out == Counter({(1, 1, 6): 2, (2, 1, 6): 1, (2, 2, 1): 1, (None, 1, 6): 1, (None, None, 0): 2, (3, 1, 6): 2, (4, 2, 1): 1, (5, 1, 6): 1})
    kept = jaccard_join.keep_first(d)
    assert kept.columns == d.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, base), (2, other), (None, "  "), (None, None)], key=str)


def test_jaccard_join_splits_and_stops(spark, monkeypatch):
    """Small buckets and blocks: large nodes of unlike sets are split, a cluster of alike ones is compared in tiles; links equal brute force."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 2000)
    rng = np.random.default_rng(1)
    shared = [f"s{i}" for i in range(120)]
    texts = [" ".join(shared[:60] + [f"u{n}x{i}" for i in range(60)]) for n in range(40)]
    texts += [" ".join(w if rng.random() > 0.01 else f"e{n}" for w in shared) for n in range(40)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    wanted = {i: sum(j != i and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.id: r.n_links for r in jaccard_join.near_duplicates(d).collect()} == wanted and max(wanted.values()) > 10


def mixed(rows, tree, fraction, max_epochs, order):
    """(doc_id, epoch) by plain Python: budgets as fractions of what is left, and of each leaf whole epochs and a prefix. order: each row's place in the epoch that is cut."""
    leaf = lambda r: (tree.sources.get(r.source, ("other", 0))[0], r.lang if r.lang in tree.languages else "other", r.source if r.source in tree.sources else "other")
    tokens = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    supply = Counter()
    for r in rows:
        supply[leaf(r)] += tokens[r]

    def share(path, amount):
        if len(path) == 3:
            return {path: amount}
        children = sorted({x[: len(path) + 1] for x in supply if x[: len(path)] == path})
        most = {c: max_epochs * sum(t for x, t in supply.items() if x[: len(c)] == c) for c in children}
        open_, left, given = [c for c in children if most[c]], min(amount, sum(most.values())), dict.fromkeys(children, 0)
        while open_ and left:
            whole = sum(tree.weight(c) for c in open_)
            full = [c for c in open_ if left * tree.weight(c) / whole >= most[c]]
            if not full:
                exact = {c: left * tree.weight(c) / whole for c in open_}
                given.update({c: int(x) for c, x in exact.items()})
                ranked = sorted(open_, key=lambda c: (int(exact[c]) - exact[c], children.index(c)))
                for c in ranked[: left - sum(given[c] for c in open_)]:
                    given[c] += 1
                break
            for c in full:
                given[c] = most[c]
                left -= most[c]
            open_ = [c for c in open_ if c not in full]
        return {k: v for c in children for k, v in share(c, given[c]).items()}

    chosen = Counter()
    for path, budget in share((), int(fraction * sum(supply.values()))).items():
        here = [r for r in rows if leaf(r) == path]
        full, rest = divmod(budget, supply[path]) if supply[path] else (0, 0)
        held, edge = 0, None
        for place in sorted({order[r] for r in here}):
            held += sum(tokens[r] for r in here if order[r] == place)
            if held > rest:
                edge = place
                break
        for r in here:
            for e in range(full + (edge is not None and order[r] < edge)):
                chosen[r.doc_id, e] += 1
    return chosen


def order_of(spark, rows, tree, fraction, max_epochs):
    """Each row's place in the order of the epoch that its leaf cuts."""
    leaves = [F.col(c) for c in mixing._LEAF]
    light = rows.select("doc_id", "text", "lang", "source", *mixing._leaf(tree, F.col("lang"), F.col("source")), mixing.n_tokens(F.col("text")).alias("n"))
    supply = {tuple(r[:3]): r[3] for r in light.groupBy(*leaves).agg(F.sum("n")).collect()}
    given = mixing.budgets(supply, tree, int(fraction * sum(supply.values())), max_epochs)
    full = spark.createDataFrame([(*k, given[k] // t if t else 0) for k, t in supply.items()], "__domain string, __lang string, __source string, full bigint")
    place = F.pmod(F.xxhash64(F.lit(mixing.SEED), "full", "doc_id", F.xxhash64("text")), F.lit(1 << 40))
    return {r.doc_id: r.u for r in light.join(full, list(mixing._LEAF)).select("doc_id", place.alias("u")).collect()}


@pytest.mark.parametrize("fraction,max_epochs", [(0.8, 2), (0.3, 1), (1.7, 3)])
def test_mixing(spark, odd, fraction, max_epochs):
    assert mixing.split(10, [1, 1, 2], [1, 100, 100]) == [1, 3, 6]
    given = mixing.budgets({("a", "x", "1"): 10, ("a", "x", "2"): 100, ("b", "x", "3"): 100}, mixing.Tree({"a": 1, "b": 1}, {}, {}), 100, 1)
    assert given == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("b", "x", "3"): 50}
    docs = documents(spark)
    found = Counter((r.doc_id, r.epoch) for r in mixing.mix(docs, fraction=fraction, max_epochs=max_epochs).collect())
    places = order_of(spark, docs, mixing.TREE, fraction, max_epochs)
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    assert found == mixed(rows, mixing.TREE, fraction, max_epochs, {r: places[r.doc_id] for r in rows})
    assert mixing.mix(odd).count() >= 0 and mixing.mix(odd.limit(0)).count() == 0


def test_tool_chat(spark):
    rows = [
        (1, 0, "user", 'hi "q"'), (1, 1, "assistant", '{"tool_calls":[{"id":"a","name":"search","arguments":{"query":"x"}},{"id":"b","name":"search","arguments":{"zz":1}}]}'), (1, 2, "tool", '{"tool_call_id":"b","content":{"y":1,"a":2}}'),
        (1, 3, "tool", '{"tool_call_id":"none"}'), (2, 0, "tool", '{"tool_call_id":"k","content":1}'), (2, 1, "assistant", '{"tool_calls":[{"id":"k","name":"calculator","arguments":{"expression":"1"}}]}'), (None, None, None, None), (3, 0, "user", "{bad"),
    ]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("kind", F.lit("x"))
    out = {(r.conv_id, r.turn): r for r in tool_chat.format_chat(d).collect()}
    assert len(out) == len(rows) and out[1, 1].errors == "b query: missing; b zz: unexpected" and out[2, 1].valid
    assert out[1, 2].json == '{"content":{"a":2,"y":1},"role":"tool","tool_call_id":"b"}' and out[1, 3].errors == "no call"
    assert (out[2, 0].place_turn, out[2, 0].place_step) > (out[2, 1].place_turn, out[2, 1].place_step)
    assert tool_chat.format_chat(d.limit(0)).count() == 0


def test_token_file(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    ids = token_file.encode_ids(odd, path, 2)
    by_rank = token_file.ranking(ids)
    out = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_file.read_blocks(token_file.write_blocks(ids, by_rank), by_rank).collect()))
    wanted = sorted((i is not None, i or 0, len(e) + 1, zlib.crc32(np.array([*e, 2], "<u4").tobytes())) for i, x, *_ in ODD for e in [t.encode(x or "", add_special_tokens=False).ids])
    assert [(a, b, n, c) for a, b, _, n, c in out] == wanted
    assert [s for _, _, s, _, _ in out] == list(np.cumsum([0] + [n for _, _, _, n, _ in out[:-1]]))
    none = token_file.encode_ids(odd.limit(0), path, 2)
    assert token_file.read_blocks(token_file.write_blocks(none, token_file.ranking(none)), token_file.ranking(none)).count() == 0
    numbers = np.array([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1], dtype=np.uint32)
    assert (token_file.unpack(*token_file.pack(numbers), len(numbers)) == numbers).all()


def test_html(spark):
    page = '<html><body><nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div><article><h1>T &amp; x</h1><p>One<br>two<p>Three</article><div id="comments"><p>Nice!</p></div><div>Site line</div><footer>f</footer>'
    other = "<html><body><main><p>Else</p></main><div>Site line</div>"
    rows = [(1, "http://h.org/a/1", page), (2, "http://h.org/a/2", other), (3, None, None), (4, "http://lone.org/", "<p>x"), (4, "http://lone.org/", "<p>x"), (5, "::bad", "")]
    out = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    assert out == [(1, "T & x One two Three", 19), (2, "Else", 4), (3, "", 0), (4, "x", 1), (4, "x", 1), (5, "", 0)]
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_text.op10_html_extraction(spark, SF).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        assert r.text == re.sub(r"\s+", " ", html_lib.unescape(re.sub(r"<[^>]+>", " ", body))).strip()


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for f, sql in ((sharding.op1_shards, sharding.OP1_SQL), (exact_dedup.op5_exact_dedup, exact_dedup.OP5_SQL)):
        found = f(spark, SF)
        wanted = con.sql(f"SELECT {', '.join(found.columns)} FROM ({sql})").fetchall()
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))


def test_pipeline(spark):
    """Every stage by plain Python on what the one before has kept, down to the ids."""
    import sentencepiece

    import corpus_pipeline

    source = {r.doc_id: r for r in documents(spark).select("doc_id", "text", "lang", "source").collect()}
    docs = {i: r.text for i, r in source.items()}
    good = {r.doc_id for r in quality_rules.op4_quality_rules(spark, SF).collect() if r.kept}
    first: dict[str, int] = {}
    for i in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i]), i)
    left = sorted(first.values())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in left if (w := docs[i].lower().split())}
    meets = defaultdict(list)
    for i in left:
        for g in sets[i]:
            meets[g].append(i)
    root = {i: i for i in left}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in {(i, j) for same in meets.values() for i in same for j in same if i < j}:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    survivors = {find(i) for i in left}
    kept = documents(spark).filter(F.col("doc_id").isin(survivors))
    places = order_of(spark, kept, mixing.TREE, mixing.FRACTION, mixing.MAX_EPOCHS)
    rows = [source[i] for i in survivors]
    wanted = Counter(i for (i, _), n in mixed(rows, mixing.TREE, mixing.FRACTION, mixing.MAX_EPOCHS, {r: places[r.doc_id] for r in rows}).items() for _ in range(n))
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == wanted and all(r.round_trip and r.parity for r in out)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_piece.model_path())
    assert all(list(r.ids) == sp.encode(docs[r.doc_id]) for r in out)


def test_pipeline_on_odd_rows(spark, odd):
    import corpus_pipeline

    for docs in (odd, odd.limit(0)):
        for i, (_, f) in enumerate(corpus_pipeline.STAGES):
            found = f(spark, docs, SF)
            assert i == len(corpus_pipeline.STAGES) - 1 or found.columns == docs.columns
            docs = spark.createDataFrame(found.collect(), found.schema)
