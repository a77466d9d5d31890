"""The registered opN_ queries, as the driver calls them, on a small folder: against their SQL or a plain version of their contract."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from dossier.llm import near_dedup, secret_scan
from dossier.llm.queries import PIECES, WORD_BPE, tokenizer_path

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PLANTED = [
    None, "", " \t\n", "42 !?", "xoxb-1234567890ab and ghp_" + "a" * 40, "-----BEGIN RSA PRIVATE KEY-----\ntoken = eyJhbGciOiJI.eyJzdWIiOiIx.abc-d",
    "é 🎉 password: 'p4ssw0rd/long' AKIA" + "Q" * 16 + " " + "0a" * 20, "Same text", " Same\ttext ", "SAME text",
]
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables with planted documents and pages behind them."""
    path = tmp_path_factory.mktemp("planted")
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    more = pd.DataFrame({"doc_id": range(10**6, 10**6 + len(PLANTED)), "text": PLANTED, "lang": "en", "source": None, "n_chars": 0})
    pd.concat([docs, more.astype(docs.dtypes.to_dict())], ignore_index=True).to_parquet(path / "documents.parquet", index=False)
    pages = pd.read_parquet(f"{SMALL}/pages.parquet")
    more = pd.concat([pages.head(7), pages.head(3), pages.head(2)], ignore_index=True)
    more["page_id"] = np.arange(10**6, 10**6 + len(more))
    more.loc[10:, "html"] = [None, ""]
    pd.concat([pages, more.astype(pages.dtypes.to_dict())], ignore_index=True).to_parquet(path / "pages.parquet", index=False)
    os.symlink(f"{SMALL}/embeddings.parquet", path / "embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def texts(folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    return {int(i): None if pd.isna(t) else t for i, t in zip(docs.doc_id, docs.text, strict=True)}


def crc(i):
    return zlib.crc32(str(i).encode())


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def rows_of(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op7_topk_search", "op10_source_mixing"])
def test_query_equals_its_sql(spark, folder, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = connection.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    plain = lambda rows: sorted(tuple("" if x is None else str(x) for x in r) for r in rows)
    assert plain(got.select(*columns).collect()) == plain([r[i] for i in at] for r in want.fetchall())


def test_op1_contract_columns(spark, folder, texts):
    found = rows_of(spark, "op1_lm_score", folder)
    count = Counter(w for i, t in texts.items() if crc(i) % 5 != 1 for w in tokens(t))
    total, kinds = sum(count.values()), len(count)
    assert {r.doc_id for r in found} == set(texts) and len(found) == len(texts)
    for r in found:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 5 == 1, len(own), sum(w in count for w in own), total)
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own), rel=1e-9)
        assert r.score < 0


def test_op2_spans_and_digest(spark, folder, texts):
    found = {r.doc_id: r for r in rows_of(spark, "op2_secret_scan", folder)}
    kinds, rules = Counter(), secret_scan.RULES
    base = len(secret_scan.BASE_RULES)
    # the base kinds as the contract words them
    plain = [(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8), ("AKIA[A-Z0-9]+", 0, 0, 16), ("[0-9a-f]+", 0, 0, 32)]
    plain += [(r.pattern, re.A | (re.I if r.ignore_case else 0), r.group, r.min_chars) for r in rules[base:]]
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        spans = sorted((m.start(), k, m.end()) for k, (p, flags, g, n) in enumerate(plain) for m in re.finditer(p, text or "", flags) if len(m[g]) >= n)
        joined = lambda some: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in some)
        own = Counter(rules[k].kind for _, k, _ in spans)
        kinds += own
        r = found[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.spans) == (own["assign"], own["access"], own["hex"], joined(spans))
        assert r.base_sha256 == hashlib.sha256(joined([s for s in spans if s[1] < base]).encode()).hexdigest()
    assert all(kinds[r.kind] for r in rules)


def test_op4_classes_equal_all_pairs(spark, folder, texts):
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + near_dedup.SHINGLE]) for k in range(max(1, len(words) - near_dedup.SHINGLE + 1))}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= near_dedup.SIMILARITY * max(len(x), len(y)) and len(x & y) >= near_dedup.SIMILARITY * len(x | y):
                p, q = sorted((top(a), top(b)))
                label[q] = p
    size = Counter(top(i) for i in ids)
    found = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in rows_of(spark, "op4_minhash_dedup", folder)}
    assert found == {i: (top(i), size[top(i)], top(i) == i) for i in ids}


def test_op5_counts_equal_library(spark, folder, texts):
    import sentencepiece
    from tokenizers import Tokenizer, models

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    library = Tokenizer(models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], 0, True))
    found = {r.doc_id: r.n_tokens for r in rows_of(spark, "op5_token_counts", folder)}
    assert found == {i: len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for i, t in texts.items()}


def test_op6_holds_out_and_rejects(spark, folder, texts):
    docs = pd.read_parquet(f"{folder}/documents.parquet").set_index("doc_id")
    found = {r.doc_id: r for r in rows_of(spark, "op6_language_id", folder)}
    assert found.keys() == texts.keys()
    for i, r in found.items():
        lettered = any(c.isalpha() for c in texts[i] or "")
        assert r.held_out == (crc(i) % 4 == 2) and 0 <= r.score <= 1 and (r.lang_pred == "und") == (not lettered)
    # held-out accuracy on texts that leave no doubt, well beyond the length where dictionaries tie
    some = [(r.lang_pred, docs.lang[i]) for i, r in found.items() if r.held_out and i < 10**6 and len(texts[i] or "") > 200 and docs.lang[i] is not None]
    assert len(some) > 20 and np.mean([a == b for a, b in some]) > 0.95


def test_op8_pieces_are_the_documents_ids(spark, folder, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    pieces, windows = {}, {}
    for r in rows_of(spark, "op8_packing", folder):
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    total = 0
    for i, own in pieces.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for held in windows.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 4096
    assert len(windows) <= total / 4096 * 1.05 + 1


def test_op9_records(spark, folder):
    pages = pd.read_parquet(f"{folder}/pages.parquet")
    payload = {int(i): ("" if pd.isna(h) else h).encode() for i, h in zip(pages.page_id, pages.html, strict=True)}
    last = {}
    for i, p in payload.items():
        last[p] = max(i, last.get(p, i))
    found = {r.page_id: r for r in rows_of(spark, "op9_warc", folder)}
    assert found.keys() == payload.keys()
    for i, p in payload.items():
        kind = ("response", None) if last[p] == i else ("revisit", last[p])
        r = found[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *kind)
    assert any(r.record_type == "revisit" for r in found.values())
