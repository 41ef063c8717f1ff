import hashlib
import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanframe import cli, lexicon
from spanframe.config import Settings
from spanframe.functions.text import slot_count
from spanframe.operators import scoring
from spanframe.plans import adapters, audit, benchmark, generate, report
from spanframe.sources import files, sinks
from spanframe.streaming.spans import stream_spans, windowed_latency

#: Digest of the published 300-row set of seed 42.
SHA256 = "84025f8e7fd50c905258864c3a93349f565e17a75b208f98ad29f431656d69f6"


@pytest.fixture(scope="module")
def examples(spark):
    return generate.exact_frame(spark).cache()


def test_lexicon_sizes():
    assert (len(set(lexicon.SURNAMES)), len(set(lexicon.TOP_SURNAMES)), len(lexicon.GIVEN_CHARACTERS)) == (39, 100, 41)
    assert (len(lexicon.DIVISIONS), len(lexicon.TEMPLATES), set(lexicon.SURNAMES) <= set(lexicon.TOP_SURNAMES)) == (22, 17, True)


def test_the_exact_set_is_byte_identical():
    assert hashlib.sha256(generate.to_lines(generate.exact_examples(42)).encode()).hexdigest() == SHA256


def test_spans_hold_and_negatives_have_none():
    for r in generate.exact_examples(3):
        ends = 0
        for s in r["entities"]:
            assert ends <= s["start"] < s["end"] <= len(r["text"])
            ends = s["end"]
        assert bool(r["entities"]) == (r["tier"] != "negative")


class Scripted(random.Random):
    """Draws that follow a script."""

    def __init__(self, script):
        super().__init__(0)
        self.script = list(script)

    def choice(self, seq):
        return self.script.pop(0)


def test_blocked_names_are_drawn_again():
    row = generate.RowDraws(Scripted("王"), "easy", frozenset({"王小明"}))
    row.rng.script = ["王", 2, "小", "明", "陳", 1, "宇"]
    assert row.name() == "陳宇" and not row.rng.script
    row.blocked, row.rng = frozenset(s + g for s in lexicon.SURNAMES for g in lexicon.GIVEN_CHARACTERS), random.Random(1)
    row.rng.choice = lambda seq: 1 if seq == (1, 2) else seq[0]
    with pytest.raises(RuntimeError):
        row.name()
    with pytest.raises(ValueError, match="no such slot"):
        row.value("PLANET")


def test_sample_covers_every_cell(spark, examples):
    rows = audit.checked_rows(examples).orderBy("ord").select("cells").collect()
    cells = [set(r.cells) for r in rows]
    for seed in (1, 42):
        drawn = audit.draw_sample(cells, seed=seed)
        assert len(set(drawn)) == 30 and set().union(*[cells[i] for i in drawn]) == set().union(*cells)
    for size in (3, 301):
        with pytest.raises(ValueError, match="rows"):
            audit.draw_sample(cells, size)


def answered(blank):
    text = blank.replace("- [ ] agree", "- [x] agree").replace("- [ ] no", "- [x] no").replace("- [ ] PASS", "- [x] PASS")
    return text.replace("Reviewer:", "Reviewer: R").replace(f"{audit.DATE}:", f"{audit.DATE}: 2024-05-01").replace("Summary:", "Summary: none")


def test_forms(spark, examples):
    blank = audit.render_form(examples, SHA256)
    done = answered(blank)
    lenient = "﻿" + done.replace("- [x] agree", "*  [ Ｘ ]  agree").replace("|---|---|---|", "| :---: |---|--- |").replace("\n", "  \r\n")
    forms = {"blank": blank, "answered": done, "none": None, "lenient": lenient} | {
        "row text": done.replace("Tier `", "Tier  `", 1),
        "row gone": done.replace("### Unlabeled entities\n", "", 1),
        "two boxes": done.replace("- [ ] disagree", "- [x] disagree", 1),
        "no box": done.replace("- [x] agree", "- [ ] agree", 1),
        "odd mark": done.replace("- [x] agree", "- [v] agree", 1),
        "note on the box": done.replace("- [x] agree", "- [x] agree but", 1),
        "no note": done.replace("- [x] agree\n- [ ] disagree", "- [ ] agree\n- [x] disagree", 1),
        "no reviewer": done.replace("Reviewer: R", "Reviewer:"),
        "no date": done.replace("2024-05-01", "2024-02-30"),
        "other set": done.replace(SHA256, "0" * 64),
        "FAIL": done.replace("- [x] PASS", "- [ ] PASS").replace("- [ ] FAIL", "- [x] FAIL"),
    }
    table = spark.createDataFrame([(k, t, blank, SHA256) for k, t in forms.items()], "form string, text string, blank string, sha256 string").cache()
    found = {r.form: r for r in audit.check_forms(table).collect()}
    assert (found["blank"].state, found["blank"].problems, len(found["blank"].incomplete)) == ("in progress", [], found["answered"].total)
    assert (found["answered"].state, found["answered"].problems, found["answered"].incomplete) == ("PASS", [], [])
    assert (found["none"].state, found["none"].problems, found["none"].total) == ("not started", [], 0)
    assert found["lenient"].problems == [] and (found["FAIL"].state, found["FAIL"].problems) == ("FAIL", [])
    for what in set(forms) - {"blank", "answered", "none", "lenient", "FAIL"}:
        assert found[what].problems, what
    assert "holds 'v'" in found["odd mark"].problems[0] and "line " in found["odd mark"].problems[0]
    frozen = {r.form: r.problems for r in audit.check_forms(table, frozen=True).collect()}
    assert frozen["answered"] == [] and all(any("frozen" in x for x in frozen[k]) for k in ("none", "blank", "FAIL"))
    check = audit.check_form(spark, done, blank, SHA256, frozen=True)
    assert check.ok and (check.state, check.total) == ("PASS", found["answered"].total)


def test_files(spark, examples, tmp_path):
    path = tmp_path / "t" / "set.jsonl"
    sinks.write_text(path, generate.to_lines(generate.exact_examples(42)) + "\n")
    rows = files.validated_rows(spark, str(path))
    assert rows.count() == 300 and rows.drop("ord").exceptAll(examples.drop("ord")).count() == 0
    assert files.file_hashes(spark, str(path)).first().size == path.stat().st_size
    assert [r.text for r in files.first_sentences(spark, str(path), 2).collect()] == [r["text"] for r in generate.exact_examples(42)[:2]]
    assert files.folder_mib(spark, str(tmp_path)) > 0 and files.folder_mib(spark, str(tmp_path / "none")) is None
    sinks.write_text(tmp_path / "bad.jsonl", '{"id":"a","text":"x","entities":[{"start":0,"end":5,"label":"ORG"}]}\n')
    with pytest.raises(ValueError, match=r"bad.jsonl:1 \(a\)"):
        files.validated_rows(spark, str(tmp_path / "bad.jsonl"))
    with pytest.raises(FileExistsError):
        sinks.write_text(path, "", force=False)
    sinks.write_text(tmp_path / "words.txt", "# c\n 王 \n\n #x\n李\r\n")
    assert files.word_list(spark, str(tmp_path / "words.txt")) == ["王", "#x", "李"]
    assert files.optional_json(spark, str(tmp_path / "none.json"), "a int").count() == 0


class Failing(adapters.PatternSystem):
    name = "failing"

    def spans(self, text):
        return F.raise_error(F.lit("boom")).cast("array<struct<start:int,end:int,label:string>>")


class Missing(adapters.PatternSystem):
    name = "missing"

    def load(self):
        raise adapters.Unavailable("no model here")


def test_benchmark_and_report(spark, examples, tmp_path):
    registry = adapters.default_registry()
    registry.add("failing", Failing, "broken")
    registry.add("missing", Missing, "broken")
    assert registry.resolve(["broken", "regex", "gliner2", "all"]) == ["failing", "missing", "regex", "gliner2_en", "gliner2_zh", "presidio", "llm"]
    with pytest.raises(KeyError):
        registry.resolve(["nobody"])
    gold = examples.select("id", "text", F.col("entities").alias("spans"), "tier", "ord")
    assert benchmark.run_all(registry, ["all"], gold, tmp_path, "set.jsonl", SHA256) == 1
    order = ("regex", "failing", "missing", "absent")
    results = report.load_results(tmp_path, order)
    micro = results["regex"]["metrics"]["exact"]["micro"]
    assert (micro["tp"], micro["fp"], micro["fn"], micro["f1"]) == (345, 173, 108, 0.7106)
    assert results["regex"]["metrics"]["overlap"]["micro"]["tp"] == 453
    assert results["regex"]["metrics"]["negatives"] == {"n": 50, "examples_with_any_prediction": 16, "fpr": 0.32}
    assert results["regex"]["metrics"]["false_entities_per_1000_chars"] == 22.526
    assert results["regex"]["metrics"]["by_tier"]["hard"] == {"exact_micro_f1": 0.6868, "overlap_micro_f1": 0.9585}
    assert results["missing"]["reason"] == "no model here" and "boom" in results["failing"]["reason"]
    assert len((tmp_path / "predictions" / "regex.jsonl").read_text().splitlines()) == 300
    assert (results["regex"]["latency_ms"]["n"], results["regex"]["latency_ms"]["warmup"]) == (290, 10) and 0 < results["regex"]["latency_ms"]["p50"] <= results["regex"]["latency_ms"]["p95"]
    # the same predictions from what was stored
    again = adapters.stored_registry(spark, str(tmp_path))
    assert benchmark.run_all(again, ["regex"], gold, tmp_path / "again", "set.jsonl", SHA256) == 0
    assert benchmark.run_all(again, ["gliner2"], gold, tmp_path / "again", "set.jsonl", SHA256) == 1
    replayed = report.load_results(tmp_path / "again")
    assert replayed["regex"]["metrics"] == results["regex"]["metrics"] and replayed["regex"]["metadata"]["model_id"] == "lexicon-patterns"
    assert (replayed["regex"]["latency_ms"], replayed["gliner2_en"]["reason"]) == (None, "no stored predictions of gliner2_en")
    read = files.result_documents(spark, str(tmp_path), order).select("key", "metrics.exact.micro.f1").collect()
    assert [tuple(r) for r in read] == [("regex", 0.7106), ("failing", None), ("missing", None)]
    text = report.benchmark_document(results, {"regex": "Patterns"})
    assert text == report.benchmark_document(json.loads(json.dumps(results)), {"regex": "Patterns"}) and "| Patterns | 0.6617 | 1.0000 | 0.5051 | 0.7106 | 0.9331 | 0.3200 |" in text
    target = tmp_path / "R.md"
    sinks.write_text(target, text)
    assert report.drift(target, text) == [] and report.drift(target, text + "x\n")
    assert report.replace_section(f"a{report.BEGIN}x{report.END}b", "new") == f"a{report.BEGIN}\nnew\n{report.END}b"
    with pytest.raises(ValueError, match="no <!--"):
        report.replace_section("nothing", "x")


@pytest.mark.skipif("SPANFRAME_STORED" not in os.environ, reason="needs the published predictions")
def test_published_scores(spark, examples, tmp_path):
    folder = Path(os.environ["SPANFRAME_STORED"])
    gold = examples.select("id", "text", F.col("entities").alias("spans"), "tier", "ord")
    assert benchmark.run_all(adapters.stored_registry(spark, str(folder)), ["all"], gold, tmp_path, "set.jsonl", SHA256) == 0
    for key, found in report.load_results(tmp_path).items():
        want = json.loads((folder / f"{key}.json").read_text())["metrics"]
        assert json.loads(json.dumps(found["metrics"])) == want, key


def test_one_sentence_at_a_time(examples):
    answer = adapters.PatternSystem().one()()
    rows = adapters.PatternSystem().predict(examples).join(examples.select("id", "text"), "id").collect()
    assert all([tuple(s) for s in r.spans] == answer(r.text) for r in rows)


def test_language_model_responses(spark):
    rows = spark.createDataFrame([("a", "王小明在台北", 0), ("b", "x王小明y王小明", 1), ("c", "無", 2), ("d", "無", 3)], "id string, text string, ord int")
    stored = [("a", '{"spans":[{"text":"台北","label":"ADDRESS"},{"text":"王小明","label":"PERSON"}]}'), ("b", '{"spans":[{"text":"王小明","label":"PERSON"},{"text":"王小明","label":"PERSON"},{"text":"李四","label":"PERSON"},{"text":"","label":"ORG"}]}'), ("c", "not json")]
    system = adapters.ResponseSystem("llm", spark.createDataFrame(stored, "id string, response string"), adapters.Metadata("m", "1", data_leaves_machine=True), [("甲", "{}")], "find")
    found = {r.id: [tuple(s) for s in r.spans] for r in system.predict(rows).collect()}
    assert found == {"a": [(0, 3, "PERSON"), (4, 6, "ADDRESS")], "b": [(1, 4, "PERSON"), (5, 8, "PERSON")], "c": [], "d": []}
    texts = sum(len(t.encode()) for t in ("王小明在台北", "x王小明y王小明", "無", "無"))
    assert system.counters(rows) == {"parse_failures": 2, "unlocated_spans": 1, "relocated_spans": 1, "ignored_spans": 1, "span_location": "surface-text", "bytes_sent": texts + 4 * (4 + 3 + 2)}
    gold = rows.withColumn("spans", F.array().cast("array<struct<start:int,end:int,label:string>>")).withColumn("tier", F.lit("negative"))
    document = benchmark.evaluate(system, gold, benchmark.base_metadata("p", "s", 4))
    assert (document["status"], document["metadata"]["relocated_spans"], document["metrics"]["negatives"]["fpr"], document["latency_ms"]) == ("evaluated", 1, 0.5, None)


def test_labels_outside_the_domain_and_many_systems(spark):
    gold = spark.createDataFrame([("a", "xy", "easy", [(0, 1, "ORG")])], "id string, text string, tier string, spans array<struct<start:int,end:int,label:string>>")
    predictions = spark.createDataFrame([("p", "a", [(0, 1, "OTHER")]), ("q", "a", [(0, 1, "ORG"), (1, 2, "OTHER")])], "system string, id string, spans array<struct<start:int,end:int,label:string>>")
    counts = scoring.row_counts(scoring.join_predictions(gold, predictions)).where("rule = 'exact' and label = 'ORG'")
    assert {r.system: (r.tp, r.fp, r.fn) for r in counts.collect()} == {"p": (0, 0, 1), "q": (1, 0, 0)}
    many = spark.range(scoring.MOST_SYSTEMS + 1).select(F.col("id").cast("string").alias("system"))
    with pytest.raises(ValueError, match="systems"):
        scoring.join_predictions(gold, predictions, many)


def test_splits_of_a_file_are_numbered_through(spark, tmp_path):
    lines = [json.dumps({"id": f"r{i}", "text": "字" * (i % 40), "entities": []}, ensure_ascii=False) + ("\r" if i % 3 else "") for i in range(500)]
    lines[100] = ""
    (tmp_path / "set.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = files.json_lines(spark, str(tmp_path / "set.jsonl"))
        assert rows.rdd.getNumPartitions() >= 1 and files.numbered_lines(spark, str(tmp_path / "set.jsonl")).count() == 500
        assert {r.ord: r.id for r in rows.collect()} == {i: f"r{i}" for i in range(500) if i != 100}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_small_sources(spark, tmp_path):
    sinks.write_text(tmp_path / "blocklist.txt", "王小明\n")
    assert files.blocked_names(spark, str(tmp_path / "blocklist.txt")) == {"王小明"} and files.blocked_names(spark) == frozenset()
    assert [r.name for r in files.word_table(spark, str(tmp_path / "blocklist.txt")).collect()] == ["王小明"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.blocked_names(spark, str(tmp_path / "nothing.txt"))
    sinks.write_text(tmp_path / "wordpiece.json", '{"model": {"unk_token": "[UNK]"}}')
    sinks.write_text(tmp_path / "unigram.json", '{"model": {"unk_id": 1, "vocab": [["<s>", 0.0], ["<unk>", 0.0]]}}')
    sinks.write_text(tmp_path / "none.json", '{"model": {"vocab": []}}')
    assert [files.unknown_token(spark, str(tmp_path / f"{n}.json")) for n in ("wordpiece", "unigram")] == ["[UNK]", "<unk>"]
    with pytest.raises(ValueError, match="no unknown token"):
        files.unknown_token(spark, str(tmp_path / "none.json"))
    for name, text in (("a", '{"id":"1","text":"x","entities":[]}'), ("b", '{"id":"2","text":"y","entities":[],"tier":"hard"}')):
        sinks.write_text(tmp_path / f"{name}.jsonl", text + "\n")
    both = files.source_union(spark, {n: str(tmp_path / f"{n}.jsonl") for n in ("a", "b")}).collect()
    assert {(r.source, r.id, r.tier) for r in both} == {("a", "1", None), ("b", "2", "hard")}
    sinks.write_text(tmp_path / "dump.json", '[{"id":"1","tokens":["a"],"num_ids":3},{"id":"2","tokens":[],"num_ids":2}]')
    dump = files.token_dump(spark, str(tmp_path / "dump.json"))
    assert [(r.id, r.num_ids) for r in dump.orderBy("id").collect()] == [("1", 3), ("2", 2)]
    sinks.write_dump(dump.select("id", F.col("num_ids").alias("tokenizer")), str(tmp_path / "dumps"), "tokenizer")
    assert spark.read.parquet(str(tmp_path / "dumps")).where("tokenizer = 3").first().id == "1"
    sinks.write_text(tmp_path / "runs.json", '{"model":"m","condition":"c","cold_load_ms":2.5,"first_inference_ms":1,"latencies_ms":[1,2],"error":null,"timed_out":false}')
    assert files.timed_runs(spark, str(tmp_path / "runs.json")).first().latencies_ms == [1.0, 2.0]
    assert files.file_hashes(spark, str(tmp_path / "blocklist.txt")).first().sha256 == hashlib.sha256("王小明\n".encode()).hexdigest()


def test_settings(monkeypatch):
    monkeypatch.setenv("SPANFRAME_SEED", "7")
    monkeypatch.setenv("SPANFRAME_API_KEY", "hidden")
    assert Settings().seed == 7 and "hidden" not in repr(Settings())


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    testset, audit_file, out, readme = (tmp_path / n for n in ("set.jsonl", "AUDIT.md", "results", "README.md"))
    same = ["--testset", str(testset), "--audit", str(audit_file), "--out", str(out)]
    assert cli.main(["generate", *same]) == 0 and hashlib.sha256(testset.read_bytes()).hexdigest() == SHA256
    assert cli.main(["audit-sample", *same]) == 0 and cli.main(["audit-check", *same]) == 0
    assert "in progress: 0 of" in capsys.readouterr().out
    with pytest.raises(FileExistsError):
        cli.main(["audit-sample", *same])
    audit_file.write_text(answered(audit_file.read_text()))
    assert cli.main(["audit-check", "--frozen", *same]) == 0 and "PASS" in capsys.readouterr().out
    assert cli.main(["benchmark", "--systems", "regex", "llm", *same]) == 1
    readme.write_text(f"# R\n{report.BEGIN}\n{report.END}\n")
    assert cli.main(["report", "--check", "--readme", str(readme), *same]) == 1
    assert cli.main(["report", "--readme", str(readme), *same]) == 0 and cli.main(["report", "--check", "--readme", str(readme), *same]) == 0
    text = readme.read_text()
    assert text.index("Patterns and lexicon") < text.index("Language model (few-shot)") and "0.7106" in text


def dump_row(i, source, text, tokens, ids, unknown=()):
    at, offsets = 0, []
    for t in tokens:
        width = 1 if t == "[UNK]" else len(t.removeprefix("##"))
        offsets.append([at, at + width])
        at += width
    spans = [{"start": s, "end": s + 1, "text": text[s]} for s in unknown]
    return {"id": i, "source": source, "tier": None, "text": text, "text_len_chars": len(text), "entities": [{"start": 0, "end": 2, "label": "ORG"}], "input_ids": [1, *ids, 2], "tokens": ["[CLS]", *tokens, "[SEP]"],
            "offsets": [[0, 0], *offsets, [0, 0]], "special_tokens_mask": [1, *[0] * len(tokens), 1], "content_tokens": tokens, "num_ids": len(ids) + 2, "unk_char_spans": spans}


def test_token_and_run_reports(spark, tmp_path):
    left = [dump_row("a", "test", "台北市路", ["台北", "##市", "路"], [5, 6, 7]), dump_row("b", "test", "甲乙☃丙", ["甲乙", "[UNK]", "丙"], [5, 0, 8], [2]), dump_row("c", "hard", "：：", ["::"], [9] * 600, [0, 1])]
    left[2]["tokens"], left[2]["content_tokens"], left[2]["offsets"] = ["[CLS]", "::", "[SEP]"], ["::"], [[0, 0], [0, 2], [0, 0]]
    right = [left[0], left[1] | {"input_ids": [1, 5, 1, 8, 2], "content_tokens": ["甲乙", "丙"]}]
    sinks.write_text(tmp_path / "left_m.json", json.dumps(left, ensure_ascii=False))
    sinks.write_text(tmp_path / "right_m.json", json.dumps(right, ensure_ascii=False))
    assert cli.main(["token-report", "--dumps", str(tmp_path), "--out", str(tmp_path / "out")]) == 0
    r = json.loads((tmp_path / "out" / "tokens.json").read_text())["m"]
    assert [(r["parity"][s]["total"], r["parity"][s]["matches"], r["parity"][s]["mismatch_ids"]) for s in ("test", "hard")] == [(2, 1, ["b"]), (1, 0, ["c"])]
    assert (r["parity"]["all"]["match_rate"], r["token_counts"]["hard"]["over_cap_ids"], r["token_counts"]["test"]["over_cap_ids"]) == (0.333333, ["c"], [])
    assert (r["unknown"]["test"], r["unknown"]["hard"]["texts"]) == ({"unk_chars": 1, "chars": 8, "rate": 0.125, "texts": ["☃"]}, ["：", "："][:1])
    plain, folded, other = r["rebuilt"]["left"]["plain"], r["rebuilt"]["left"]["folded"], r["rebuilt"]["right"]["plain"]
    assert (plain["tokens"], plain["tokens_right"], plain["entities"], plain["entities_right"], plain["uneven"]) == (7, 6, 3, 2, 0)
    assert (folded["tokens_right"], folded["mismatch_examples"], [m["id"] for m in plain["mismatch_examples"]]) == (7, [], ["c"])
    assert (other["rows"], other["uneven"], other["tokens_right"]) == (2, 1, 3)
    run = {"model": "m", "condition": "c", "cold_load_ms": 2.0, "first_inference_ms": 1.0, "latencies_ms": [1.0, 3.0], "error": None, "timed_out": False}
    sinks.write_text(tmp_path / "one.json", json.dumps([run | {"run_id": "1"}, run | {"run_id": "2", "error": "lost"}]))
    sinks.write_text(tmp_path / "two.json", json.dumps([run | {"run_id": "2", "error": "lost"}, run | {"run_id": "3", "cold_load_ms": 4.0, "latencies_ms": [5.0]}]))
    assert cli.main(["run-report", "--runs", str(tmp_path / "one.json"), str(tmp_path / "two.json"), "--out", str(tmp_path / "out")]) == 0
    (found,) = json.loads((tmp_path / "out" / "runs.json").read_text())["runs"]
    assert (found["ok_run_count"], found["cold_load_ms_median"], found["latency_p50"], found["latency_n"]) == (2, 3.0, 3.0, 3)


def test_limit_takes_the_first_rows(spark, examples, tmp_path):
    gold = examples.select("id", "text", F.col("entities").alias("spans"), "tier", "ord")
    assert benchmark.run_all(adapters.default_registry(), ["regex"], gold, tmp_path, "p", SHA256, limit=5) == 0
    assert report.load_results(tmp_path, ("regex",))["regex"]["metadata"]["n_examples"] == 5


def test_python_models_plug_in(spark, examples):
    def build():
        return lambda text: [(0, 1, "per"), (0, 1, "misc")]

    system = adapters.PandasSystem("m", build, adapters.Metadata("m", "1"), {"per": "PERSON"})
    assert {tuple(s) for r in system.predict(examples.limit(3)).collect() for s in r.spans} == {(0, 1, "PERSON")}


def test_stream(spark, tmp_path, examples):
    examples.select("id", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, text string").parquet(str(tmp_path / "in"))
    q = stream_spans(stream).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == 518


def test_windowed_latency_of_a_stream(spark, tmp_path):
    rows = [(f"2024-05-01 {h:02}:{m:02}:00", kind, float(10 * h + m)) for h in range(3) for m in range(0, 60, 5) for kind in ("a", "b")]
    events = spark.createDataFrame(rows, "ts string, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_latency(stream).writeStream.outputMode("complete").format("memory").queryName("latency").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    found = {(r.window_start.hour, r.event_type): (r.p50, r.n) for r in spark.table("latency").collect()}
    assert found == {(h, kind): (10 * h + 25.0, 12) for h in range(3) for kind in ("a", "b")}


def test_slots_of_a_template(spark):
    df = spark.createDataFrame([("{PERSON}在{ADDRESS}，{DATE}，{PERSON}",), ("none",)], "t string")
    assert [r.n for r in df.select(slot_count(F.col("t"), ("PERSON", "ADDRESS", "ORG")).alias("n")).collect()] == [3, 0]
