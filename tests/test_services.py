"""A chat service, settings, and models of scores and of romanised languages."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from vakya.operators import models
from vakya.plans import pipeline
from vakya.sources.chat import Chat, ChatError
from vakya.sources.settings import Settings


@pytest.fixture
def service():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def answer(self, status, body):
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self.answer(200, {"models": [{"name": "m"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            text = body["messages"][1]["content"]
            if body["format"] != "json":
                self.answer(400, {"error": "no schemas"})
            elif text == "down" or (text == "once" and sum(b["messages"][1]["content"] == "once" for b in seen) == 1):
                self.answer(500, {})
            else:
                self.answer(200, {"message": {"content": json.dumps({"english_text": "the road is " + text, "sentiment": "Neutral", "confidence": 0.5})}})

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_a_service_is_asked_again_and_without_a_schema_it_refuses(service):
    url, seen = service
    ask = Chat(url, "m", schema='{"type": "object"}', wait_s=0.01)()
    assert json.loads(ask(["dry"], "p")[0])["english_text"] == "the road is dry" and [b["format"] for b in seen] == [{"type": "object"}, "json"]
    assert len(ask(["wet", "once"], "p")) == 2 and all(b["format"] == "json" for b in seen[2:]) and len(seen) == 5
    with pytest.raises(ChatError, match="500"):
        ask(["down"], "p")
    assert Chat(url, "m").healthy() and not Chat(url, "other").healthy() and not Chat("http://127.0.0.1:9", "m").healthy()
    with pytest.raises(ChatError):
        Chat("http://127.0.0.1:9", "m", retries=0)()(["x"], "p")


def test_failed_posts_through_a_service(spark, service):
    posts = spark.createDataFrame([(1, "రోడ్డు"), (2, "down")], "id bigint, post_text string").withColumn("x", F.lit(1))

    def fail():
        def call(texts, lang):
            raise RuntimeError

        return call

    got = {r["id"]: r for r in pipeline.analyze(posts, primary=fail, fallback=Chat(service[0], "m", wait_s=0.01)).collect()}
    assert got[1]["english_text"] == "the road is రోడ్డు" or got[1]["failure"]  # what the gate says of it
    assert got[2]["language"] == "en" and got[2]["sentiment"] == "Neutral"


def test_settings():
    assert Settings.from_env({}) == Settings() and Settings.from_env({"VAKYA_MAX_TEXTS": "5", "VAKYA_FALLBACK": "yes", "VAKYA_CHAT_MODEL": " "}) == Settings(max_texts=5, fallback=True)
    with pytest.raises(ValueError, match="VAKYA_MAX_TEXTS"):
        Settings.from_env({"VAKYA_MAX_TEXTS": "many"})


def scorer():
    def call(texts, lang):
        if any("boom" in t for t in texts):
            raise ValueError
        return [[0.7, 0.1] if "bad" in t else [0.1, 0.9] for t in texts]

    return call


def test_scores_of_a_model(spark):
    posts = spark.createDataFrame([(1, "a bad road"), (2, "a fine road"), (3, "boom"), (4, "a bad road")], "id bigint, post_text string")
    got = {r["id"]: r for r in pipeline.analyze(posts, classifier=scorer, classes={0: "NEG", 1: "POS"}).collect()}
    assert [got[i]["sentiment"] for i in (1, 2, 3, 4)] == ["Negative", "Positive", None, "Negative"] and got[3]["failure"] == "sentiment"
    assert abs(sum(got[1]["probs"]) - 1) < 1e-9 and got[1]["total_time_ms"] == got[1]["sentiment_time_ms"] > 0


def ranker():
    def call(texts, lang):
        return [[{"label": "tel_Latn", "score": 0.9}] if "vallu" in t else [{"label": "eng_Latn", "score": 0.95}] if "road" in t else [{"label": "hin_Latn", "score": 0.3}] for t in texts]

    return call


def second():
    return lambda texts, lang: ["eng_Latn" if "road" in t else "tam_Latn" for t in texts]


def test_romanised_languages_by_models(spark):
    df = spark.createDataFrame([(1, "vallu chala bagundi ani anukuntunnaru ippudu"), (2, "the road is bad"), (3, "naan varen poren saptiya inga"), (4, None), (5, " ")], "id int, x string")
    got = {r["id"]: r["roman"] for r in models.romanised(df, "x", ranker, second).collect()}
    assert got == {1: "te", 2: "en", 3: "ta", 4: None, 5: None}
