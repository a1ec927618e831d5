import random

import public_tokenizers as P

import corpus_pipeline as cp
from fathom.llm.bpe import Codec, read_ranks
from tests.llm.helpers import SF, edge_docs, least_reachable, shingles, words


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        new = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append((name, docs.collect(), new.collect()))
        if k < len(cp.STAGES) - 1:
            assert new.columns == docs.columns
        docs = new
    (_, a, b), (_, _, lines), (_, before, one), (_, pool, mixed), (_, text, ids) = kept
    assert len(b) == len(a)  # every document of the table is in a learned language
    assert len(lines) == len(b)
    sets = {r.doc_id: shingles(r.text) for r in before}
    order = sorted(sets)

    def linked(i, j):
        x, y = sets[order[i]], sets[order[j]]
        return bool(x & y) and 100 * len(x & y) >= 80 * len(x | y)

    assert sorted(r.doc_id for r in one) == sorted(set(least_reachable(order, linked)))
    total = {s: sum(len(words(r.text)) for r in pool if r.source == s) for s in {r.source for r in pool}}
    took = {s: sum(len(words(r.text)) for r in mixed if r.source == s) for s in total}
    assert abs(sum(took.values()) - 1.5 * sum(total.values())) <= 2 * len(total)
    assert all(took[s] <= 2 * total[s] for s in total)
    codec = Codec(read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    assert sorted((r.doc_id, codec.enc.encode_ordinary(r.text or "")) for r in text) == sorted((r.doc_id, r.ids) for r in ids)
    assert all(r.round_trip for r in ids)


def test_run_reads_documents(spark):
    got = cp.run(spark, SF)
    assert got.count() > 0 and "ids" in got.columns


def test_stages_take_edge_rows_and_empty_tables(spark):
    for docs in (edge_docs(spark), edge_docs(spark).limit(0)):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
]


def test_foreign_text_and_noise_go_and_short_clean_texts_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(11)
    noise = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (8, 20, 200)]
    table = docs.collect()
    clean = []
    for r in sorted((r for r in table if len(r.text or "") > 30), key=lambda r: (len(r.text), r.doc_id))[:8]:
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        clean += [r.text, r.text.upper(), f"{r.text} 4785380592391139 +1 (777) 555-7427 token = \"{key}\""]
    learned = {r.lang: r.text for r in table if len(r.text or "") > 500}
    clean.append("\n".join(t[:400] for t in learned.values()))  # in all learned languages
    texts = FOREIGN + [t * 20 for t in FOREIGN] + noise + clean
    rows = [(10 ** 9 + i, t, None, "planted", len(t)) for i, t in enumerate(texts)]
    more = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in cp.identify_language(spark, more, SF).collect()}
    bad = 2 * len(FOREIGN) + len(noise)
    assert [t[:60] for i, t in enumerate(texts) if (10 ** 9 + i in kept) != (i >= bad)] == []
    assert {r.doc_id for r in table} <= kept
