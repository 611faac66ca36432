import json
import struct
import wave

import numpy as np
import pytest

from parley.sources import audio, documents


def test_wav(spark, tmp_path):
    t = np.arange(800) / 8000
    tone = np.sin(2 * np.pi * 200 * t)
    with wave.open(str(tmp_path / "a.wav"), "wb") as out:
        out.setnchannels(2)
        out.setsampwidth(2)
        out.setframerate(8000)
        out.writeframes(np.repeat((tone * 32767).astype("<i2"), 2).tobytes())
    (tmp_path / "b.wav").write_bytes(b"nothing")
    (tmp_path / "c.mp3").write_bytes(b"x")
    rows = {r.path[-5:]: r for r in audio.read_wav(spark, str(tmp_path)).collect()}
    good = rows["a.wav"]
    assert (good.sample_rate, good.channels, len(good.samples)) == (8000, 2, 1600)
    assert good.duration_s == pytest.approx(0.1) and np.allclose(good.samples[::2], tone, atol=1e-3)
    assert rows["b.wav"].error == "not a WAV file"
    assert [r.reason for r in audio.unsupported(spark, str(tmp_path)).collect()] == ["not supported yet"]
    values = np.array([1, 2.5, -3.7, 0, 100.1], "<f4")
    blobs = spark.createDataFrame([(1, values.tobytes()), (2, b"abc"), (3, None)], "id int, vector binary")
    got = {r.id: r.vector for r in audio.blob_vectors(blobs).collect()}
    assert np.allclose(got[1], values) and got[2] is None and got[3] is None
    cut = audio.cut_segments(spark.createDataFrame([(good.path, 0, 100)], "path string, start_ms long, end_ms long"), audio.read_wav(spark, str(tmp_path)))
    assert len(audio.with_embeddings(cut).first().vector) == 512
    for bits, kind, data in ((24, 1, b"\x00\x00\x40"), (32, 3, struct.pack("<f", 0.5)), (8, 1, bytes([192]))):
        head = b"fmt " + struct.pack("<IHHIIHH", 16, kind, 1, 8000, 0, 0, bits)
        assert audio.decode(b"RIFF\0\0\0\0WAVE" + head + b"data" + struct.pack("<I", len(data)) + data)[2].tolist() == [0.5]


def test_documents(spark, tmp_path):
    seg = {"speaker_id": "s", "start_time": 1.5, "end_time": 2.0, "text": "hi", "quality": 0.5}
    (tmp_path / "a.json").write_text(json.dumps({"recording_id": "r", "segments": [seg]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"audio_file": "f", "segments": [seg | {"confidence": 0.9}]}))
    rows = documents.read_truth(spark, str(tmp_path / "*.json"))
    assert sorted((r.recording, r.start_ms, r.confidence) for r in rows.collect()) == [("f", 1500, 0.9), ("r", 1500, 0.5)]
    assert json.loads(documents.truth_json(rows).where("recording_id = 'r'").first().json)["segments"][0]["start_time"] == 1.5
    (tmp_path / "x.trans.txt").write_text("10-20-0001 HELLO THERE\n\n10-20-0002\n")
    assert sorted((r.utt_id, r.speaker, r.text) for r in documents.read_transcripts(spark, str(tmp_path)).collect()) == [("10-20-0001", "10", "HELLO THERE"), ("10-20-0002", "10", "")]
    lists = spark.createDataFrame([('[{"id":"1","date":"2024-01-02T03:04:05Z"}]', '[{"id":"1"},{"id":"2"}]')], "a string, b string")
    assert sorted(r.id for r in documents.meeting_rows(lists, "a", "b").collect()) == ["1", "1", "2"]
    own = spark.createDataFrame([("m", 0, "a", 0, 1500, "hi")], "meeting string, seq long, speaker string, start_ms long, end_ms long, text string")
    assert documents.captions(own, "vtt").first().body == "WEBVTT\n\n00:00:00.000 --> 00:00:01.500\na: hi\n"
    assert documents.captions(own, "txt").first().body == "a: hi"


def test_long_wav_files_are_read_by_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from parley.sources import wav

    wav.register(spark)
    pick = np.random.default_rng(1)
    long, place = np.round(pick.uniform(-1, 1, 200_000) * 32767) / 32768, str(tmp_path / "w")
    spark.createDataFrame([("long", 16_000, long.tolist()), ("none", 8000, [])], "name string, sample_rate int, samples array<double>").write.format("wav").mode("append").save(place)
    with wave.open(f"{place}/long.wav") as own:
        assert (own.getframerate(), own.getnchannels(), own.getsampwidth(), own.getnframes()) == (16_000, 1, 2, 200_000)
    (tmp_path / "w" / "bad.wav").write_bytes(b"nothing")
    (tmp_path / "w" / "x.mp3").write_bytes(b"nothing")
    stereo = struct.pack("<hh", 8192, 16384) * 70_000
    (tmp_path / "w" / "stereo.WAV").write_bytes(b"RIFF\0\0\0\0WAVELIST" + struct.pack("<I", 3) + b"abc\0fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 0, 0, 16) + b"data" + struct.pack("<I", len(stereo)) + stereo)
    read = spark.read.format("wav").option("partbytes", "50000").load(place)
    rows = read.withColumn("task", F.spark_partition_id()).collect()
    by = {name: sorted((r for r in rows if r.path.rsplit("/", 1)[1].startswith(name)), key=lambda r: r.start or 0) for name in ("long", "none", "bad", "stereo")}
    assert np.allclose(np.concatenate([r.samples for r in by["long"]]), long) and len({r.task for r in by["long"]}) == 9
    assert [r.start for r in by["long"]] == np.cumsum([0] + [len(r.samples) for r in by["long"]])[:-1].tolist()
    assert [(r.n_frames, r.samples) for r in by["none"]] == [(0, [])] and [r.error for r in by["bad"]] == ["not a WAV file"]
    assert sum(len(r.samples) for r in by["stereo"]) == 70_000 and set(by["stereo"][0].samples) == {0.375}
    heads = spark.read.format("wav").option("samples", "false").load(place).where("error is null").collect()
    assert {(r.path.rsplit("/", 1)[1], r.n_frames, r.samples) for r in heads} == {("long.wav", 200_000, None), ("none.wav", 0, None), ("stereo.WAV", 70_000, None)}
    (tmp_path / "e").mkdir()
    assert spark.read.format("wav").load(str(tmp_path / "e")).count() == 0
