import json

import pytest

from lexiloom.operators.ranking import latest
from lexiloom.sources import readers, sinks
from lexiloom.streaming import state


def test_lessons_of_both_shapes(spark, tmp_path):
    lesson = {"id": "a", "level": "A", "title": "T", "titleZh": "题", "sentences": [{"id": "1", "english": "Hi."}], "sourceName": "s"}
    (tmp_path / "a.json").write_text(json.dumps([lesson, lesson]))
    (tmp_path / "b.json").write_text(json.dumps({"lessons": [lesson]}))
    (tmp_path / "c.json").write_text("broken")
    got = readers.lessons(spark, str(tmp_path)).collect()
    assert len(got) == 3 and got[0].title_zh == "题" and got[0].sentences[0].english == "Hi."


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('\ufeff级别,课程id,Title,text\n"A",L-1,"T, t","He said ""hi""\nthere"\n,,,\nA,L-1,T,Second\n', encoding="utf-8")
    rows = readers.csv_rows(spark, str(tmp_path / "x.csv")).collect()
    assert rows[0].title == "T, t" and rows[0].english == 'He said "hi"\nthere' and rows[0].chinese is None
    df = spark.createDataFrame([(i + 1, r.level, r.lesson_id, r.title, None, None, r.english, None) for i, r in enumerate(rows)], "record_no int, level string, lesson_id string, title string, title_zh string, sentence_id string, english string, chinese string")
    lessons, sentences = readers.csv_lessons(df), readers.csv_sentences(df)
    assert [(r.lesson_id, r.n_sentences) for r in lessons.collect()] == [("L-1", 2)]
    assert sorted((r.position, r.id) for r in sentences.collect()) == [(1, "L-1-1"), (2, f"L-1-{len(rows)}")]
    (tmp_path / "y.csv").write_text("level,title\nA,T\n")
    with pytest.raises(ValueError):
        readers.csv_rows(spark, str(tmp_path / "y.csv"))


def test_ocr_cache(spark, tmp_path):
    rows = [{"path": "p", "orientation": "up", "score": 1.0, "lines": []}, {"path": "p", "orientation": "up", "score": 3.0, "lines": []}, {"path": "p", "orientation": "down", "score": 3.0, "lines": []}, {"path": "q", "error": "x"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nbroken")
    got = readers.ocr_cache(spark, str(tmp_path / "c.jsonl")).collect()
    assert [(r.path, r.orientation, r.score) for r in got] == [("p", "up", 3.0)]


def test_small_readers(spark, tmp_path, one):
    (tmp_path / "ids.txt").write_text("# all\n\nRAZ-A-1\n RAZ-B-2 \n")
    assert [r.id for r in readers.listed(spark, str(tmp_path / "ids.txt"), ["B"]).collect()] == ["RAZ-B-2"]
    assert readers.files(spark, str(tmp_path), ".txt").count() == 1
    assert readers.json_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0
    log = "Duration: 00:01:02.50, start\nsilence_start: 1.5\nsilence_end: 2.0 | x\nsilence_start: 3\nsilence_end: 2.5"
    assert [tuple(x) for x in one(readers.silences, log)] == [(1.5, 2.0)] and one(readers.log_duration, log) == 62.5
    grid = 'name = "phones" xmin = 0 xmax = 9 text = "x" name = "words" xmin = 0 xmax = 0.5 text = "" xmin = 0.5 xmax = 1 text = "hi" xmin = 1 xmax = 2 text = "you" xmin = 2 xmax = 3 text = "<eps>"'
    assert tuple(one(readers.grid_bounds, grid)) == (0.5, 2.0, 2)
    t = spark.createDataFrame([("k", 0, "ice cream", 1.0, 2.0, 0.9), ("k", 1, "x", 2.0, 2.03, 0.9), ("k", 2, "...", 3.0, 4.0, 0.9)], "key string, seq int, text string, start double, end double, probability double")
    assert [(r.word, r.start, r.end) for r in readers.timed_parts(t).orderBy("part").collect()] == [("ice", 1.0, 1.5), ("cream", 1.5, 2.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "A", "pass"), ("b", "B", "review")], "id string, level string, status string")
    sinks.packages(df, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p/levels")).count() == 2 and spark.read.json(str(tmp_path / "p/passed")).count() == 1
    for rows in (df, df.limit(1)):
        sinks.published(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 and not (tmp_path / "t.staging").exists()
    sinks.quarantined(df.selectExpr("id", "if(id = 'a', true, null) as passed"), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q/rejected")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [("u1", 1), ("u2", 5), ("u1", 3), ("u3", 1)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "k string, v int").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("k string, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for _ in range(2):  # a second run finds nothing new
        state.follow(source, str(tmp_path / "t"), str(tmp_path / "log"), ["k"], ["v"]).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "t")).drop("bucket")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, latest(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"]).collect()))


def test_attempts_by_stream(spark, tmp_path):
    rows = [("u", "w", i, r) for i, r in enumerate([False, False, True, True])] + [("u", "x", i, False) for i in range(4)]
    spark.createDataFrame(rows, "user_id string, word string, attempt int, right boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = state.fold_attempts(spark.readStream.schema("user_id string, word string, attempt int, right boolean").parquet(str(tmp_path / "in")))
    s.writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("folded").collect())) == [("u", "w", 2, "correct"), ("u", "x", 3, "revealed")]


def test_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("level,lesson_id,title,text\nA,1,T,x\n")
    (tmp_path / "b.csv").write_text("text,title,extra,lesson_id,level\ny,U,e,2,B\n")
    got = sorted((r.level, r.lesson_id, r.title, r.english) for r in readers.csv_rows(spark, str(tmp_path)).collect())
    assert got == [("A", "1", "T", "x"), ("B", "2", "U", "y")]


def test_engine(spark):
    from lexiloom.sources.engines import called

    def client():
        def ask(x):
            if x == "bad":
                raise ValueError("no")
            return x * 2

        return ask

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "k int, v string")
    assert sorted(map(tuple, called(df, "k", "v", client, attempts=2, pause=0).collect())) == [(1, "aa", None, 1), (2, None, "ValueError: no", 2), (3, None, None, 0)]


def test_lines_are_appended_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    at = str(tmp_path / "lines")
    assert [sinks.appended_lines(x, at, ["k"]).count() for x in (df.limit(0), df, df, df.selectExpr("k + 1 as k", "v"))] == [0, 2, 0, 1]


def test_checkpoints_need_a_shared_folder():
    from types import SimpleNamespace

    from lexiloom.session import checkpoint_folder

    nowhere = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x:7077"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        checkpoint_folder(nowhere)
