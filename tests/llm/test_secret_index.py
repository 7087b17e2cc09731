"""The trigram index of the secret scan: queries, postings, many spans in one text, odd columns."""

import re

from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.llm import secret_scan as S


def test_queries_drop_what_another_alternative_implies():
    query = S.trigram_query(S.BASE_RULES[0].pattern, True)
    assert all(not any('"' in t or "'" in t for t in S.trigrams_of(q)) for q in query[1])
    assert S.trigram_query("(abcd|bcd)x?") == "bcd" and S.trigram_query("abc|xy") is None and S.trigram_query("(abc|def)") == ("or", ("abc", "def"))


def test_postings_and_candidates(spark):
    texts = ["my PASSWORD is", "pass word swo wor ord ssw", "akia", "kia aki", "", "eyJ xoxb-", "://"]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    wanted = S.wanted_trigrams(S.RULES)
    index = S.build_index(df)
    assert sorted((r.key, wanted[r.trigram]) for r in index.collect()) == sorted((i, t) for i, text in enumerate(texts) for t in wanted if t in text.lower())
    masks = {r["key"]: {S.RULES[i].kind for i in range(len(S.RULES)) if r["mask"] >> i & 1} for r in S.candidates(index).collect()}
    assert masks == {0: {"assign"}, 1: {"assign"}, 2: {"access"}, 3: {"access"}, 5: {"chat", "web_token"}, 6: {"url_login"}}
    scans = (S.Rule("hex", "[0-9a-f]+", least=24),)
    assert S.build_index(df, scans).count() == 0 == S.candidates(S.build_index(df, scans), scans).count()


def test_many_spans_in_a_long_text(spark):
    text = "é token=abcdef " * (3 * T.BLOCK) + "x" * 2_000_000 + " deadbeefdeadbeefdeadbeef"
    df = spark.createDataFrame([(1, text), (2, text), (2, text), (None, text), (3, None)], "doc_id long, text string")
    want = [f"assign:{m.start()}:{m.end()}" for m in re.finditer(r"token=\w+", text)] + [f"hex:{len(text) - 24}:{len(text)}"]
    got = S.secret_query(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "2", "3", "None"]
    assert all(r.spans == (",".join(want) if r.doc_id != 3 else "") and r.n_assign == (3 * T.BLOCK if r.doc_id != 3 else 0) for r in got)


def test_redaction_keeps_columns_of_any_type(spark):
    df = spark.createDataFrame([(1, "a token=abcdef b", {"k": 1}, [1], None)], "doc_id long, text string, lacuna_key map<string,int>, `w0.x` array<int>, n_chars int")
    out = S.redact_documents(df)
    assert out.columns == df.columns and out.first()[:4] == (1, "a [SECRET] b", {"k": 1}, [1])
    assert S.redact_documents(df.limit(0)).count() == 0 and S.scan_documents(df.withColumn("spans", F.lit(1))).count() == 1


def test_logins_of_any_length(spark):
    long = f"x https://{'u' * 500}:{'p' * 5000}@host y ftp://a:b@host http://a:bcd@e"
    spans = S.scan_documents(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().spans
    want = [m.span() for m in re.finditer(r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+-]{3,}@", long)]
    assert len(want) == 2 and [(s.start, s.end) for s in spans if s.kind == "url_login"] == want
