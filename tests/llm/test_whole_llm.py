"""Corpus operators that must do the whole job, against plain Python."""

import json
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import html_text, license_scan, sentence_piece, token_file, tool_chat

SF = "/root/testdata/sf0.001"


def extracted(spark, rows):
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return sorted((r.page_id, r.text) for r in html_text.extract_text(d).collect())


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_template_is_deleted_beside_copies_and_over_partition_ends(spark, parts):
    """Unclassed menus without an <article>: only what a page has of its own is left, in copies too; a host's only page keeps all."""
    page = lambda n: f"<p>Home<p>About us<p>Story {n} of the day<p>Site line" if n != 11 else ""
    rows = [(i, f"http://h.org/{n:02d}/{i:03d}", page(n)) for i, n in enumerate(n for n in range(20) for _ in range(1 + 7 * (n % 3)))]
    wanted = [(i, f"Story {int(u[13:15])} of the day" if h else "") for i, u, h in rows]
    alone = [(1000 + i, f"http://h{i}.org/", page(0)) for i in range(9)] + [(2000 + i, "http://lone.org/", page(1)) for i in range(9)]
    wanted += [(i, f"Home About us Story {i // 2000} of the day Site line") for i, *_ in alone]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert extracted(spark, rows + alone) == sorted(wanted)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_differencing_decides_outside_an_article(spark):
    """Shared with the page on one side only: line one with the first page, line two with the third."""
    page = lambda n, *lines: (n, f"http://h.org/{n}", f"<nav>Menu {n}</nav><article><p>Text {n}<p>Shared passage</article>" + "".join(f"<div>{x}</div>" for x in lines))
    assert extracted(spark, [page(1, "one"), page(2, "one", "two", "own"), page(3, "two")]) == [(1, "Text 1 Shared passage"), (2, "Text 2 Shared passage own"), (3, "Text 3 Shared passage")]


def test_added_tokens_get_their_ids(spark):
    """Texts with an added token's string, against the library as it is loaded."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z <|endoftext|><|endoftext|>", "a <|endoftext b", "no <| mark |> here", "word " * 300 + "<|endoftext|> word"]
    ids = token_file.encode_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path, 2)
    by_rank = token_file.ranking(ids)
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_file.read_blocks(token_file.write_blocks(ids, by_rank), by_rank).collect()}
    wanted = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert sum(t.token_to_id("<|endoftext|>") in w for w in wanted) == 4
    starts = np.cumsum([0, *map(len, wanted)])
    assert found == {i: (starts[i], len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in enumerate(wanted)}


def test_alignment_is_longest_and_linear_in_memory():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return row[-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ([str(rng.randint(0, rng.randint(1, 6))) for _ in range(rng.randint(0, 14))] for _ in range(2))
        shared = [x for x, same in zip(a, html_text.shared_lines(a, b), strict=True) if same]
        rest = iter(b)
        assert len(shared) == length(a, b) and all(x in rest for x in shared)
    a, b = ([f"line {rng.randint(0, 17_000)}" for _ in range(50_000)] for _ in range(2))
    began = time.time()
    assert sum(html_text.shared_lines(a, b)) > 0 and time.time() - began < 30


def test_licenses_of_the_whole_table(spark):
    """Words, places and base labels of every document by regular expressions, and the templates' containment in every block."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    templates = {k: set(word.findall(t)) for k, t in license_scan.TEMPLATES.items()}
    for r in license_scan.op2_license_scan(spark, SF).collect():
        words = word.findall(lower(texts[r.doc_id]))
        places = sorted((i, label) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        base = {label for _, label in places}
        blocks = []
        for paragraph in re.split(r"\n[^\S\n]*\n", re.sub(r"[\x00-\x09\x0b-\x2F\x3A-\x60\x7B-\x7F]", " ", lower(texts[r.doc_id]))):
            lines = [set(word.findall(x)) for x in paragraph.split("\n")]
            blocks += [*lines, set().union(*lines)]
        share = {k: max((len(t & b) / len(t) for b in blocks), default=0) for k, t in templates.items()}
        met = {k for k, v in share.items() if v >= 0.8 - 1e-9}
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | met))
        assert r.score == pytest.approx(1.0 if base else max((share[k] for k in met), default=0.0))


def test_ids_of_the_whole_table(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_piece.model_path())
    found = {r.doc_id: r for r in sentence_piece.op3_sentencepiece(spark, SF).collect()}
    for i, t in rows:
        ids = sp.encode(t)
        assert (found[i].n_tokens, found[i].ids_crc32, found[i].parity) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True) and found[i].round_trip == (sp.decode(ids) == t)
    encoded = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch([t for _, t in rows], add_special_tokens=False)
    start, wanted = 0, []
    for (i, _), e in zip(rows, encoded, strict=True):
        ids = [*e.ids, 2]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_file.op9_token_file(spark, SF).collect()) == wanted


@pytest.mark.parametrize("text", ["é ü  z\u2003q", "a \x1cb \x0bc \x85d", "\n\n x\n y \n", " lead", "trail ", "a\u00a0 b", "\t a\tb ", "", " ", "don't we'll I'M"])
def test_stretches_of_odd_white_space(text):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    wanted = np.array(Tokenizer.from_str(spec).encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert token_file.Encoder(spec).encode(pa.array([text, "x " + text])) [0] == wanted


def test_chat_of_many_calls(spark):
    """Some thousand conversations with calls, results out of order, duplicates and faults, against plain Python."""
    rng = random.Random(4)
    rows = []
    for c in range(400):
        calls = [{"id": f"c{c}-{k}", "name": rng.choice(["search", "calculator", "nowhere"]), "arguments": rng.choice([{"query": "x"}, {"expression": "1"}, {"query": 1}, {}])} for k in range(rng.randint(0, 4))]
        messages = [("user", f"hello {c}")] + ([("assistant", json.dumps({"tool_calls": calls}))] if calls else []) + [("tool", json.dumps({"tool_call_id": rng.choice(calls)["id"], "content": k})) for k in range(rng.randint(0, 3)) if calls]
        order = list(range(len(messages)))
        if rng.random() < 0.3:
            rng.shuffle(order)
        rows += [(c, turn, *messages[i]) for turn, i in enumerate(order)]
    found = {(r.conv_id, r.turn): r for r in tool_chat.format_chat(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert len(found) == len(rows)
    kinds = {"query": str, "expression": str, "limit": int}
    needed = {"search": {"query": True, "limit": False}, "calculator": {"expression": True}}
    for c in range(400):
        mine = [(t, json.loads(x) if x.startswith("{") else None, x) for cc, t, _, x in rows if cc == c]
        called = {k["id"]: (t, n) for t, v, _ in mine if v and "tool_calls" in v for n, k in enumerate(v["tool_calls"])}
        answered = {}
        for t, v, _ in sorted(mine, key=lambda m: m[0]):
            if v and "tool_call_id" in v:
                r, at = found[c, t], called[v["tool_call_id"]]
                assert (r.kind, r.link, r.place_turn, r.place_step) == ("result", v["tool_call_id"], max(t, at[0]), at[1] + 1)
                assert r.errors == ("duplicate result" if v["tool_call_id"] in answered else "")
                answered.setdefault(v["tool_call_id"], t)
        for t, v, x in mine:
            r = found[c, t]
            if v is None:
                assert r.kind == "plain" and json.loads(r.json) == {"content": x, "role": "user"} and r.valid
            elif "tool_calls" in v:
                assert (r.kind, r.n_calls, r.n_answered) == ("call", len(v["tool_calls"]), sum(k["id"] in answered for k in v["tool_calls"]))
                good = all(k["name"] in needed and set(k["arguments"]) <= set(needed[k["name"]]) and all(p in k["arguments"] or not must for p, must in needed[k["name"]].items()) and all(isinstance(y, kinds[p]) for p, y in k["arguments"].items()) for k in v["tool_calls"])
                assert r.valid == good and json.loads(r.json)["tool_calls"] == v["tool_calls"]


def test_pages_ignore_clashing_columns(spark):
    d = spark.createDataFrame([(1, "http://h.org/a", "<article><p>One</article>"), (2, "http://h.org/b", "<p>Two")], "page_id bigint, url string, html string").withColumns({"id": F.lit("x"), "text": F.lit("y"), "host": F.lit(0), "n_chars": F.lit("z")})
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(d).collect()) == [(1, "One", 3), (2, "Two", 3)]
