"""The pipeline's stages and run() against plain Python versions of all five."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
import regex
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from dossier.llm import language_id, mixing, packing
from dossier.llm.queries import WORD_BPE, crc_mod, tokenizer_path

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = {"en": "abcdefghij", "fr": "qrstuvwxyz"}
VOCABULARY = {lang: ["".join(random.Random(f"{lang}{k}").choices(letters, k=5)) for k in range(400)] for lang, letters in LETTERS.items()}


def prose(lang, n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY[lang], k=n))


def changed(text, places):
    words = text.split()
    for i in places:
        words[i] = "aqbrcs"
    return " ".join(words)


def documents():
    texts = []
    for i in range(90):
        lang = "en" if i % 3 else "fr"
        texts.append((prose(lang, (40, 120, 300)[i % 3 if i % 2 else 1], i), lang, "big" if i % 4 else "small"))
    for i in (1, 2, 5):
        t, lang, source = texts[i]
        texts += [(t, lang, source), (t.replace(" ", "  "), lang, "small"), (changed(t, [20]), lang, source), (None, None, None)]
    base = prose("en", 120, 999)
    texts += [(base, "en", None), (changed(base, [20, 50, 80]), None, "big")]  # a similarity of 101/131: no copy
    texts += [("", "en", "big"), ("12 !!", "fr", "big"), (prose("fr", 6000, 77), "fr", "small"), (prose("en", 300, 5).upper(), "en", "big")]
    return [(i, t, lang, source, len(t or "")) for i, (t, lang, source) in enumerate(texts)]


def plain_language(rows, learned):
    def size(data, raw):
        own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=language_id.LEVEL)
        pack = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=own, write_content_size=False, write_dict_id=False)
        return sum(len(pack.compress(raw[i : i + language_id.PIECE_BYTES])) for i in range(0, len(raw), language_id.PIECE_BYTES))

    kept = set()
    for r in rows:
        if r.text and any(map(str.isalpha, r.text)):
            a, b, *_ = sorted(size(d, r.text.lower().encode()) for d in learned.values())
            if (b - a) / b >= language_id.MIN_MARGIN:
                kept.add(r.doc_id)
    return kept


def plain_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    return {min(g, key=lambda r: (-len(r.text or ""), r.doc_id)).doc_id for g in groups.values()}


def plain_near(rows):
    sets = {}
    for r in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").split()
        sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


def plain_topic(text):
    if not regex.search(r"[\p{L}\p{N}|;]", text):
        return "blank"
    if len(regex.findall(r"[\p{N}|\t;]", text)) * 25 >= len(text):
        return "data"
    if len(regex.findall(r"\p{Lu}", text)) * 3 >= len(text):
        return "shout"
    return "short" if len(text) < 400 else "long" if len(text) > 8000 else "prose"


def plain_mixing(rows):
    cell = {r.doc_id: (r.source or "(null)", r.lang or "(null)", plain_topic(r.text or "")) for r in rows}
    tokens = Counter()
    for r in rows:
        tokens[cell[r.doc_id]] += len((r.text or "").split())
    targets = []
    for d in range(3):
        sums = Counter()
        for c, n in tokens.items():
            sums[c[d]] += n
        total = sum(n**mixing.TEMPER for n in sums.values())
        targets.append({k: n**mixing.TEMPER / total for k, n in sums.items()})
    weight = {c: float(n) for c, n in tokens.items()}
    for _ in range(mixing.ROUNDS):
        for d in range(3):
            held = Counter()
            for c, w in weight.items():
                held[c[d]] += w
            weight = {c: w * targets[d][c[d]] / held[c[d]] for c, w in weight.items()}
    ratio = {c: weight[c] * sum(tokens.values()) / tokens[c] for c in weight}
    most = max(ratio.values())
    chance = lambda i: int(hashlib.md5(f"{mixing.SALT}{i}".encode()).hexdigest()[:12], 16) / 2**48
    return {i for i, c in cell.items() if chance(i) < ratio[c] / most}


def plain_windows(lengths, window=4096):
    room, count = [], 0
    for n in sorted(lengths, reverse=True):
        fit = min((c for c in room if c >= n), default=None)
        if fit is None:
            count += 1
            room.append(window - n)
        else:
            room.remove(fit)
            room.append(fit - n)
    return count


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_equal_plain_versions(spark, folder):
    from tokenizers import Tokenizer

    assert list(STAGES) == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    learned = language_id.learn(docs, crc_mod(4) != 2)
    plain = {"language_id": lambda rows: plain_language(rows, learned), "exact_dedup": plain_exact, "near_dedup": plain_near, "mixing": plain_mixing}
    given = {r.doc_id: r for r in docs.collect()}
    for name, version in plain.items():
        rows = docs.collect()
        kept = STAGES[name](spark, docs, folder)
        assert kept.columns == docs.columns
        found = kept.collect()
        assert {r.doc_id for r in found} == version(rows) and len(found) == len({r.doc_id for r in found})
        assert all(r == given[r.doc_id] for r in found) and 0 < len(found) < len(rows), name
        docs = spark.createDataFrame(found, SCHEMA)
    tokenizer = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    rows, pieces = docs.collect(), STAGES["packing"](spark, docs, folder).collect()
    sizes = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows}
    held = Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == held[p.doc_id] and p.doc_tokens == sizes[p.doc_id]
        held[p.doc_id] += p.length
    assert held == sizes
    used = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == used[p.sequence_id]
        used[p.sequence_id] += p.length
    assert max(used.values()) <= 4096 and len(used) == plain_windows([p.length for p in pieces])
    whole = corpus_pipeline.run(spark, folder).collect()
    piece = lambda p: (p.doc_id, p.start, p.length, p.ids_crc32)
    assert sorted(map(piece, whole)) == sorted(map(piece, pieces)) and len({p.sequence_id for p in whole}) == len(used)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_with_clashing_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 80")
    clash = docs.withColumns({c: F.lit("x") for c in ("id", "key", "digest", "topic", "rejected", "class_id", "label", "node", "rank", "salt", "n", "before", "gone_id_", "digest_", "nth_", "kept_id_", "kept_digest_", "key_", "again_id_", "key_text_", "source_of_cell_", "probability_of_cell_", "weight", "tokens")})
    # two rows share an id with other texts, so that rows are told apart by their digests and sets
    docs, clash = (d.unionByName(d.where("doc_id = 81").withColumn("text", F.lit("another text of the same id, long enough for a shingle"))) for d in (docs, clash))
    for name in ("exact_dedup", "near_dedup", "mixing"):
        kept = STAGES[name](spark, clash, folder)
        assert kept.columns == clash.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in STAGES[name](spark, docs, folder).collect())


def test_packing_keeps_columns_with_clashing_names(spark):
    cut = spark.createDataFrame([(i, 0, 1 + i % 5, i, 1 + i % 5, "x", "y", "z") for i in range(40)], "id long, start long, length long, ids_crc32 long, doc_tokens long, rank string, salt string, before string")
    packed = packing.pack(cut, window=8)
    assert packed.columns == [*cut.columns, "sequence_id", "offset"] and {(r["rank"], r.salt, r.before) for r in packed.collect()} == {("x", "y", "z")}
    filled = {}
    for r in packed.collect():
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in f) <= 8 and [o for o, _ in sorted(f)] == [sum(n for _, n in sorted(f)[:i]) for i in range(len(f))] for f in filled.values())
