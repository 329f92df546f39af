import re

from pyspark.sql import functions as F

from candlewick.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = {}
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else []:
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((i, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def collect(df):
    return sorted([(r.doc_id, r.n_words, list(r.hits), list(r["items"])) for r in df.collect()], key=repr)


def test_against_brute_force(spark, make_docs, odd_texts, prose):
    passage = prose(9, 25)
    items = [(1, passage), (2, "short item Here"), (3, None), (4, ""), (5, "one"), (6, passage), (10, prose(2, 10)), (7, "of " * 14)]
    texts = [*odd_texts, prose(5, 30) + " " + passage.upper() + " " + prose(6, 30), passage, "a SHORT, item: here b", "of " * 5000, " ".join(passage.split()[3:13])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("kept", F.lit(1))
    docs = make_docs(texts)
    want = brute(list(enumerate(texts)), items)
    assert collect(dc.find(docs, bench)) == want
    assert collect(dc.find(docs, bench, broadcast_windows=0)) == want
    clean = {i for i, _, hits, _ in want if not hits}
    assert {r.doc_id for r in dc.remove_contaminated(docs, bench).collect()} == clean


def test_repeated_rows_and_empty_tables(spark, make_docs, prose):
    bench = spark.createDataFrame([(1, prose(1, 12))], "item_id long, text string")
    docs = make_docs([prose(1, 12)] * 3, ids=[7, 7, None])
    rows = dc.find(docs, bench).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["7", "7", "None"] and all(len(r.hits) == 12 for r in rows)
    assert dc.find(docs.limit(0), bench).count() == 0
    assert all(not r.hits for r in dc.find(docs, bench.limit(0)).collect())


def test_no_python_in_the_plan(spark, make_docs, prose):
    bench = spark.createDataFrame([(1, prose(1, 12))], "item_id long, text string")
    plan = dc.find(make_docs([prose(1, 20)]).select("doc_id", F.concat("text", F.lit("")).alias("text")), bench)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
