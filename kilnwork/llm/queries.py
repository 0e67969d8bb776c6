"""The queries of this package and the SQL they are checked against."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm import credentials, leaks, linkage, lookalike, packing, topn
from kilnwork.runtime import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    bandit = linkage.Side(
        id="result_id",
        repo="repo_hint",
        path="filename",
        line="line_number",
        time="generated_at",
        kind=F.col("test_id"),
        weaknesses=F.array_compact(F.array(F.col("issue_cwe.id"))),
    )
    numbers = F.transform("extra.metadata.cwe", lambda x: F.regexp_extract(x, r"(\d+)", 1).try_cast("int"))
    semgrep = linkage.Side(
        id="result_id",
        repo="repo_full_name",
        path="path",
        line="start.line",
        time="scanned_at",
        kind=F.substring_index("check_id", ".", -1),
        weaknesses=F.array_distinct(F.array_compact(numbers)),
    )
    return linkage.link(table(spark, d, "bandit_output"), table(spark, d, "semgrep_output"), bandit, semgrep)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).selectExpr("id_a as bandit_id", "id_b as semgrep_id")


def p1_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).selectExpr("id_a as bandit_id", "id_b as semgrep_id", "round(confidence, 2) as confidence")


def _credentials(spark: SparkSession, d: str) -> DataFrame:
    bandit = credentials.credentials(table(spark, d, "bandit_output"), "result_id", "code", numbered=True)
    findings = credentials.credentials(table(spark, d, "findings"), "id", "code_snippet")
    return bandit.select(F.lit("bandit_output").alias("source_table"), F.col("result_id").alias("record_id"), "*").drop(
        "result_id"
    ).unionByName(
        findings.select(F.lit("findings").alias("source_table"), F.col("id").alias("record_id"), "*").drop("id")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _credentials(spark, d).select("source_table", "record_id", "line_no").distinct()


def p4_places(spark: SparkSession, d: str) -> DataFrame:
    return _credentials(spark, d)


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    bandit = credentials.redacted(table(spark, d, "bandit_output"), "result_id", "code", numbered=True)
    findings = credentials.redacted(table(spark, d, "findings"), "id", "code_snippet")
    return bandit.toDF("record_id", "redacted", "n_redacted").select(
        F.lit("bandit_output").alias("source_table"), "*"
    ).unionByName(
        findings.toDF("record_id", "redacted", "n_redacted").select(F.lit("findings").alias("source_table"), "*")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "fix_suggestions")
    best = topn.top_n(table(spark, d, "findings"), 10, "scan_id", topn.severity_rank("severity"), "id", only=wanted)
    return best.selectExpr("scan_id", "id as finding_id")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "pack_sizes").select("capacity_id", "capacity_tokens").distinct()
    return packing.pack(table(spark, d, "documents"), {r.capacity_id: r.capacity_tokens for r in sizes.collect()})


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d), table(spark, d, "pack_sizes"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing, per capacity: every text is in it, tokens add up to the same for all
    capacities, nothing overflows, and only texts that exceed the capacity are cut."""
    packed = _packed(spark, d)
    per_doc = packed.groupBy("capacity_id", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("pieces"))
    sizes = table(spark, d, "pack_sizes").select("capacity_id", "capacity_tokens").distinct()
    docs = per_doc.join(sizes, "capacity_id").groupBy("capacity_id").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("t").alias("t"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("cut_in_vain")
    )
    held = packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(sizes, "capacity_id")
    held = held.groupBy("capacity_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    all_ = docs.agg(F.count_distinct("t")).first()[0]
    return docs.join(held, "capacity_id").select("capacity_id", "texts", "overfull", "cut_in_vain", F.lit(all_ == 1).alias("same_tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("eval_id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per test item: the documents it leaked into and the most words one of them reproduces."""
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("eval_id").agg(
        F.count("doc_id").alias("n_docs"),
        F.max("n_words").alias("most_words"),
        F.max("answer_words").alias("most_answer_words"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.visual_pairs(table(spark, d, "documents"))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, d, "documents")).select("doc_id", "canonical")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.visual_classes(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found,
        p1_confidence,
        p4_found,
        p4_places,
        p4_redacted,
        p5_found,
        p6_packed,
        p6_fill,
        p6_kept,
        p7_found,
        p7_report,
        p8_found,
        p8_canonical,
        p8_classes,
    )
}

# Fixed values, written out again for the check: look-alike letters, and what draws nothing.
_LETTERS = ("авеорсухіјѕһԁԛԝӏАВЕІЈКМНОРСТХУЅԚԜοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aвeopcyxijshdqwlABEIJKMHOPCTXYSQWoABEZHIKMNOPTYX")
_NOTHING = r"[\x{034F}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{00AD}\x{061C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{E0001}\x{E0020}-\x{E007F}]"


def _form_sql(text: str) -> str:
    """A text's look: nothing of what draws nothing, plain widths and blanks, letters as they look."""
    wide, plain = [*"\u00a0\u2010\u2011\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)), "\u1680"], [*" --   ", *" " * 11, " "]
    for code in range(0xFF01, 0xFFEF):
        kind, _, to = unicodedata.decomposition(chr(code)).partition("> ")
        if kind in ("<wide", "<narrow"):
            wide.append(chr(code))
            plain.append(chr(int(to, 16)))
    accented = []
    for code in range(0x370, 0x530):  # letters with accents whose base looks like another
        parts = unicodedata.normalize("NFD", chr(code))
        at = _LETTERS[0].find(parts[0])
        if len(parts) > 1 and at >= 0:
            accented.append((chr(code), unicodedata.normalize("NFC", _LETTERS[1][at] + parts[1:])))
    one = [(a, b) for a, b in accented if len(b) == 1]
    out = f"translate(regexp_replace({text}, '{_NOTHING}', '', 'g'), '{''.join(wide)}', '{''.join(plain).replace(chr(39), chr(39) * 2)}')"
    for k, ligature in enumerate(("ff", "fi", "fl", "ffi", "ffl", "st", "st")):
        out = f"replace({out}, '{chr(0xFB00 + k)}', '{ligature}')"
    out = f"translate(nfc_normalize({out}), '{''.join(a for a, _ in one)}', '{''.join(b for _, b in one)}')"
    for a, b in accented:
        out = f"replace({out}, '{a}', '{b}')" if len(b) > 1 else out
    out = f"nfc_normalize(translate({out}, '{_LETTERS[0]}', '{_LETTERS[1]}'))"
    return f"trim(regexp_replace(regexp_replace({out}, '[ \\t]+', ' ', 'g'), ' *(\\r\\n|\\r|\\n)', chr(10), 'g'), ' ' || chr(10))"


ORACLE = {
    "p6_kept": "SELECT capacity_id, (SELECT count(DISTINCT doc_id) FROM documents) AS texts, 0 AS overfull, 0 AS cut_in_vain, true AS same_tokens FROM pack_sizes",
    "p8_found": f"""WITH f AS MATERIALIZED (SELECT doc_id, text, {_form_sql('text')} AS form FROM documents WHERE text IS NOT NULL)
      SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.form <> ''""",
    "p5_found": r"""
      WITH f AS (
        SELECT scan_id, id, max(CASE lower(trim(severity, E' \t\r\n')) WHEN 'info' THEN 1 WHEN 'warning' THEN 2
          WHEN 'error' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END) AS r
        FROM findings WHERE scan_id IN (SELECT scan_id FROM fix_suggestions) GROUP BY scan_id, id
      )
      SELECT scan_id, id AS finding_id FROM f
      QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY r DESC, id) <= 10""",
}
