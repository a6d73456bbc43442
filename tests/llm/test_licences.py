"""The scan against the same rules as a plain program."""
import random
import re

from postloom.llm import licences as L

DIR = "/root/testdata/sf0.001"


def plain(text):
    """(sentence ids, licences) of a text, sentence by sentence."""
    text = text or ""
    if not re.search(r"licen|reserved|redistribut|copyright|public domain|permission|permitted|warranty|(?:released|distributed|available)\s+under", text.lower()):
        return "", ""
    text = re.sub("\r\n?", "\n", text)
    text = re.sub(r"(?m)^[ \t]*(?:(?://|#|;|--|/?\*+/?|-)+[ \t]*)*(?:\(?(?:[0-9]{1,2}|[a-zA-Z])[.)][ \t]+)?", "", text)
    text = re.sub(r"(?i)\b(spdx-license-identifier:|v\.)[ \t]+(?=[a-zA-Z0-9_(])", r"\1", text)

    def name(s):
        c = re.sub("[^a-z0-9]+", " ", s.lower()).strip()
        if c in L.SENTENCES:
            return L.SENTENCES[c]
        if re.search(L.BEFORE, c):
            short = re.sub(L.AFTER, "", re.sub(L.BEFORE, "", c))
            return L.NAMES[short] + "-ref" if short in L.NAMES else None

    ids = []
    for part in re.split("\x01", re.sub(r"([.!?;:])[ \t]+|([.!?;:])\n|\n[ \t]*\n+", lambda m: (m[1] or "") + (m[2] or "") + "\x01", text)):
        whole, lines = name(part), part.split("\n")
        if whole:
            ids.append(whole)
        else:
            ids += [x for i in range(len(lines)) if (x := name(" ".join(lines[i:])) or name(lines[i]))]
    left, out = ids, []
    for rule, licence in L.RULES:
        seq, i, hit, rest = rule.split("|"), 0, False, []
        while i < len(left):
            if left[i : i + len(seq)] == seq:
                hit, i = True, i + len(seq)
                rest.append("#")
            else:
                rest.append(left[i])
                i += 1
        left = rest
        if hit:
            out.append(licence)
    return "|".join(ids), "|".join(out)


def test_equals_the_plain_program(spark):
    r = random.Random(8)
    bits = [s.capitalize() for s in L.SENTENCES] + [f"Licensed under the {n}" for n in L.NAMES] + ["SPDX-License-Identifier: MIT", "Some words", "", "(c) 2020 x", "1. A list", "// code", "a copyright b"]
    rows = [(i, "".join(r.choice(bits).replace(" ", r.choice([" ", "\n", "  "]), r.randrange(4)) + r.choice([". ", ".\n", "\n\n", "\n", "; ", ": ", " "]) for _ in range(r.randrange(1, 9)))) for i in range(250)]
    rows += [(None, "All rights reserved."), (900, None), (901, ""), (901, "Released under the MIT License."), (902, "line\n" * 45 + "Licensed under the MIT License\n" + "more\n" * 500)]
    rows += [(1000 + x.doc_id, x.text) for x in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "doc_id long, text string, sentence_ids string, licences string").repartition(3)
    got = sorted((x.doc_id or -1, x.sentence_ids, x.licences) for x in L.scan(df).collect())
    want = sorted((d or -1, *plain(t)) for d, t in rows)
    assert [a for a, b in zip(got, want) if a != b][:2] == [b for a, b in zip(got, want) if a != b][:2]
    assert sum(bool(w[2]) for w in want) > 150


def test_every_rule_can_be_met_and_empty_tables(spark):
    made = set(L.SENTENCES.values()) | {f"{v}-ref" for v in L.NAMES.values()}
    assert all(set(seq.split("|")) <= made for seq, _ in L.RULES)
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    plan = L.scan(spark.range(1).selectExpr("id doc_id", "'x' text"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_a_grant_after_any_number_of_lines(spark):
    mit = next(s for s, k in L.SENTENCES.items() if k == "mit-grant").split(" ")
    grant = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    rows = [(n, "a note\n" * n + "---\n" * (n // 100) + grant) for n in (0, 33, 36, 45, 10_000)]
    got = {r.doc_id: r.licences for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys((0, 33, 36, 45, 10_000), "MIT")
