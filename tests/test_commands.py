"""A folder taken in, asked about, bundled, audited and evaluated by the command entries."""

import json

import pytest

from tamarack.commands import main

TOPICS = {"steel": "furnace output of the northern mill rose to 418 kilotons", "water": "reservoir levels fell by 37 percent after the dry spring", "rail": "freight wagons carried 512 loads over the new eastern line"}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    for industry, fact in TOPICS.items():
        (root / "data" / industry).mkdir(parents=True)
        (root / "data" / industry / "report.txt").write_text(f"{industry} report. {fact}. " + f"Further remarks about {industry} in plain words follow here. " * 3)
    return root


def call(capsys, spark, *arguments):
    code = main([str(a) for a in arguments], spark)
    return code, json.loads(capsys.readouterr().out)


def test_from_folder_to_evaluation(spark, world, capsys):
    at = f"file://{world}"
    code, report = call(capsys, spark, "ingest", world / "data", "--store", f"{at}/store")
    assert (code, report["status"], report["files_processed"]) == (0, "completed", 3)
    assert call(capsys, spark, "ingest", world / "data", "--store", f"{at}/store")[1]["status"] == "up_to_date"

    _, made = call(capsys, spark, "generate", "--store", f"{at}/store", "--output", f"{at}/set")
    assert made["units"] == 3
    drafts = []
    for unit in spark.read.json(f"{at}/set/units").collect():
        topic = next(t for t in TOPICS if t in unit.chunks[0].content)
        drafts.append({"unit": unit.unit, "question": f"What does the {topic} report say: {TOPICS[topic].split(' of ')[0]}?", "answer": TOPICS[topic], "evidence": [{"chunk_index": 1, "quote": TOPICS[topic]}]})
        drafts.append({"unit": unit.unit, "question": f"How many {topic} workers are there?", "answer": "There are 9999", "evidence": [{"chunk_index": 4, "quote": "nothing like it"}]})
    drafts.append({"question": "Who won the cup in that year?", "answerable": False})
    (world / "drafts.jsonl").write_text("\n".join(map(json.dumps, drafts)))
    _, counts = call(capsys, spark, "generate", "--store", f"{at}/store", "--output", f"{at}/set", "--drafts", f"{at}/drafts.jsonl")
    assert counts == {"answerable": 3, "no_answer": 1, "rejected": {"invalid_evidence_chunk_index": 3, "unsupported_answer_numbers": 3}}

    full = f"{at}/set/bundle/full"
    code, report = call(capsys, spark, "audit", "--dataset", full, "--strict")
    assert code == 1 and report["issues"] == {"review_status_pending": 4} and report["review_statuses"] == {"pending": 4}
    assert (report["total_records"], report["chunk_id_labelled"], report["no_answer_records"], report["evidence_validated"]) == (4, 3, 1, 3)

    rows = spark.read.json(full).collect()
    (world / "verdicts.jsonl").write_text("\n".join(json.dumps({"case_id": r.case_id, "behavior": "supported_answer" if r.answerable else "abstention"}) for r in rows))
    for mode in ("hybrid", "vector"):
        _, report = call(capsys, spark, "evaluate", "--dataset", full, "--store", f"{at}/store", "--output", f"{at}/run-{mode}", "--retrieval_mode", mode, "--verdicts", f"{at}/verdicts.jsonl")
        assert (report["cases"], report["retrieval"]["evaluable"], report["retrieval"]["no_answer_errors"]) == (4, 3, 0)
        assert report["retrieval"]["hit_at_k"] == 1.0 and report["answers"]["accuracy"] == 1.0
        assert spark.read.csv(f"{at}/run-{mode}/details", header=True).count() == 4
    _, report = call(capsys, spark, "evaluate", "--dataset", full, "--store", f"{at}/store", "--output", f"{at}/run-one", "--n", 2, "--retrieval_mode", "bm25")
    assert report["cases"] == 2 and "answers" not in report


def test_audit_counts_broken_lines_and_short_questions(spark, tmp_path, capsys):
    lines = [{"case_id": "a", "question": "ok?", "reference_answer": "yes", "gold_sources": [{"source_file": "f", "pages": [1]}]}, {"case_id": "a", "question": "ok?", "ground_truth": "", "gold_chunk_ids": ["c"]}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n[1]\n\n")
    code, report = call(capsys, spark, "audit", "--dataset", f"file://{tmp_path}/r.jsonl")
    assert code == 0 and report["total_records"] == 2 and report["source_page_fallback"] == 1
    assert report["issues"] == {"duplicate_case_id": 1, "duplicate_question": 1, "invalid_json": 2, "missing_reference_answer": 1, "source_page_fallback_only": 1}


def test_generate_refuses_drafts_that_do_not_hold(spark, tmp_path):
    (tmp_path / "units").mkdir()
    (tmp_path / "units" / "u.json").write_text(json.dumps({"unit": "u", "scope": "single_chunk", "source_file": "f", "industry": "", "chunks": [{"chunk_id": "u", "page": 1, "content": "some text", "table": False}]}))
    (tmp_path / "d.jsonl").write_text(json.dumps({"unit": "u", "question": "short", "answer": ""}))
    with pytest.raises(ValueError):
        main(["generate", "--store", "none", "--output", f"file://{tmp_path}", "--drafts", f"file://{tmp_path}/d.jsonl"], spark)
