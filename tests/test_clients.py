"""Clients against a local server and against transports that remember what they were sent."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from lectern.streaming import batches, clients, speech


@pytest.fixture
def server():
    loaded = []

    def load():
        loaded.append(1)

        def model(s):
            if "bad" in s:
                raise RuntimeError
            return s.replace("a", "+a")

        return model

    s = clients.stress_server(load)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}/", loaded
    s.shutdown()


def test_stress_service(spark, server):
    url, loaded = server
    client = clients.StressClient(url)
    assert client.sentences([]) == [] and not loaded
    assert client.sentences(["ab a", " ", "", "bad a"]) == ["+ab +a", " ", "", "bad a"] and client("a") == "+a" and loaded == [1]
    df = spark.createDataFrame([("One a. Two a!",), ("",)], "t string")
    assert [r[0] for r in df.select(speech.stressed(F.col("t"), client)).collect()] == ["One +a.\nTwo +a!", ""]
    with pytest.raises(OSError):
        clients.over_http("POST", url + "other", b"{}", {}, 5)
    with pytest.raises(ValueError):
        clients.StressClient("http://x", lambda *_: b'{"results": []}').sentences(["a"])


class Service:
    """Answers the batch calls of a model service from memory."""

    def __init__(self, fail=0, code=500):
        self.calls, self.fail, self.code = [], fail, code

    def __call__(self, method, url, body, headers, seconds):
        self.calls.append((method, url.removeprefix("http://m/v1"), headers.get("Authorization")))
        if self.fail:
            self.fail -= 1
            e = OSError("busy")
            e.code = self.code
            raise e
        path = self.calls[-1][1]
        if path == "/files":
            self.file = body
            return b'{"id": "f1"}'
        if path == "/batches":
            assert json.loads(body) == {"input_file_id": "f1", "endpoint": "/v1/responses", "completion_window": "24h"}
            return b'{"id": "b1", "status": "validating"}'
        if path == "/batches/b1":
            return b'{"status": "completed", "output_file_id": "f2", "error_file_id": null, "request_counts": {"total": 2, "completed": 1, "failed": 1}}'
        if path == "/files/f2/content":
            return b'{"custom_id": "t-1"}\n\n{"custom_id": "t-2"}\n'
        if path == "/responses":
            self.body = json.loads(body)
            return b'{"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "yes"}]}]}'
        return b"{}"


def test_model_service(spark, tmp_path):
    wire = Service()
    service = clients.ModelService("http://m/v1/", "k", transport=wire)
    store = batches.Store(spark, str(tmp_path))
    requests = spark.createDataFrame([("t-1", "", "hello", "m", False, 0), ("t-2", "", "you", "m", True, 9)], "custom_id string, instructions string, input string, model string, json_mode boolean, max_tokens long")
    state = batches.submit(store, service, "t", requests, [1, 2], "m")
    assert (state["batch_id"], state["input_file_id"], state["chapter_ids"], state["model"]) == ("b1", "f1", [1, 2], "m")
    assert wire.file.count(b'"custom_id"') == 2 and b'name="purpose"\r\n\r\nbatch' in wire.file
    assert batches.poll(store, service, "t", sleep=lambda _: None)["status"] == "completed"
    assert {k: store.load("t")[k] for k in ("total", "completed", "failed", "output_file_id")} == {"total": 2, "completed": 1, "failed": 1, "output_file_id": "f2"}
    seen = []
    batches.finish(store, service, "t", lambda lines: seen.extend(r["value"] for r in lines.collect()))
    assert len(seen) == 2 and store.load("t") is None
    service.cancel("b1")
    assert wire.calls[-1] == ("POST", "/batches/b1/cancel", "Bearer k")
    assert service.call("hi", "m", "be brief", True, 5) == "yes" and wire.body["instructions"] == "be brief" and wire.body["text"]["format"]["type"] == "json_object" and wire.body["max_output_tokens"] == 5


def test_retries_and_keys(monkeypatch):
    busy = Service(fail=2)
    assert clients.ModelService("http://m/v1", "k", transport=busy, pause=0).call("hi", "m") == "yes" and len(busy.calls) == 3
    for service in (Service(fail=9), Service(fail=1, code=401)):
        with pytest.raises(OSError):
            clients.ModelService("http://m/v1", "k", transport=service, pause=0).call("hi", "m")
    with pytest.raises(ValueError):
        clients.ModelService("http://m/v1", "k", transport=lambda *_: b'{"output": []}').call("hi", "m")
    monkeypatch.delenv("MODEL_API_KEY", raising=False)
    with pytest.raises(LookupError):
        clients.ModelService("http://m/v1")


def test_conversion(spark):
    assert clients.encode_command("a", "b.mp3", "mp3", "") == ["ffmpeg", "-y", "-i", "a", "-ac", "1", "-c:a", "libmp3lame", "-b:a", "128k", "b.mp3"]
    assert clients.encode_command("a", "b.aac", "AAC", "96")[6:8] == ["-c:a", "aac"] and clients.encode_command("a", "b.ogg", "ogg", "1k") == ["ffmpeg", "-y", "-i", "a", "-ac", "1", "b.ogg"]
    df = spark.createDataFrame([(bytearray(b"x"),), (None,)], "a binary")
    made = lambda kind: [r[0] and bytes(r[0]) for r in df.select(clients.converted(F.col("a"), kind, "64", lambda w, k, b: w + k.encode() + b.encode())).collect()]
    assert made("mp3") == [b"xmp364", None] and made("wav") == [b"x", None]
    assert clients.server_workers(40) == 12 and clients.server_workers(3) == 3 and clients.server_workers(3, 20) == 20
