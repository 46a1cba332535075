import base64
import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from curatrix.sources import cursors

N, SIZE = 23, 5


@pytest.fixture()
def site():
    asked, state = Counter(), {"down": set(), "once": {10}}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            v = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["variables"]
            at = json.loads(base64.b64decode(v["after"]))["offset"] if "after" in v else 0
            asked[at, v["first"]] += v["first"] == SIZE
            if at in state["down"] or at in state["once"] and v["first"] == SIZE:
                state["once"].discard(at)
                return self.send_error(503)
            nodes = [{"id": f"ds{i}"} if i != 7 else None for i in range(at, min(at + v["first"], N))]
            body = {"data": {"datasets": {"edges": [{"node": n} for n in nodes]}}, "errors": [{"message": "node 7"}] if at == 5 and v["first"] == SIZE else None}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield {"url": f"http://127.0.0.1:{server.server_port}/", "source": "s", "size": str(SIZE), "wait": "0.01", "retries": "2"}, asked, state
    server.shutdown()


def ids(df):
    return {json.loads(r.raw)["id"] for r in df.where("status = 'ok'").collect()}


def test_batch(spark, site):
    options, _, state = site
    state["down"].add(15)
    spark.dataSource.register(cursors.CursorJson)
    df = spark.read.format("cursor_json").options(**options, pages="5").load()
    assert df.rdd.getNumPartitions() == 5
    rows = spark.createDataFrame(df.collect(), df.schema)
    assert ids(rows) == {f"ds{i}" for i in range(N) if i != 7 and not 15 <= i < 20}
    assert tuple(cursors.report(rows).first()) == (5, 1, 17, 1, 1)
    assert cursors.cursor_at(0) is None and json.loads(base64.b64decode(cursors.cursor_at(25))) == {"offset": 25}


def test_stream_resumes(spark, site, tmp_path):
    options, asked, _ = site
    spark.dataSource.register(cursors.CursorJson)

    def started():
        df = spark.readStream.format("cursor_json").options(**options, pages="2").load()
        return df.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")).option("checkpointLocation", f"{tmp_path}/c").start()

    def batches():
        out = tmp_path / "out"
        return sorted(int(p.name) for p in out.iterdir()) if out.exists() else []

    q = started()
    for _ in range(600):  # stopped after the first micro-batch
        if batches():
            break
        time.sleep(0.05)
    q.stop()
    q = started()
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(*[f"{tmp_path}/out/{n}" for n in batches()])
    assert ids(rows) == {f"ds{i}" for i in range(N) if i != 7}
    assert rows.where("status = 'ok'").count() == N - 1  # none twice
    assert asked[20, SIZE] == 1  # a page of the second run is asked for once


def test_gives_up_after_three_failures(site):
    options, _, state = site
    state["down"] |= {0, 5}
    client = cursors.Client(options)
    assert client.more(0)  # two pages down, the third answers
    state["down"].add(10)
    with pytest.raises(RuntimeError, match="3 pages in a row"):
        client.more(0)
