import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest

from curatrix.sources import details


@pytest.fixture()
def site():
    asked, open_now, most = Counter(), [0], [0]
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            k = unquote(self.path.split("/")[2])
            with lock:
                asked[k] += 1
                open_now[0] += 1
                most[0] = max(most[0], open_now[0])
            if k == "gone":
                self.send_error(404)
            elif k == "down" or k == "late" and asked[k] < 3:
                self.send_error(503)
            else:
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps({"id": k, "n": len(k)}).encode())
            with lock:
                open_now[0] -= 1

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/r/{{key}}/", asked, most
    server.shutdown()


def test_each_key_once_and_every_row(spark, site):
    address, asked, most = site
    keys = ["a", "b/1", "late", "gone", "down", None] + ["hot"] * 20
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k string")
    out = details.detailed(rows, "k", "id", address=address, together=2, tries=3, wait=0.01)
    got = {r.id: r for r in out.collect()}
    assert out.count() == len(keys) and set(got) == set(range(len(keys)))
    assert [got[i].status for i in range(6)] == ["ok", "ok", "ok", "missing", "failed", "no key"]
    assert json.loads(got[1].detail) == {"id": "b/1", "n": 3} and got[2].tries == 3 and got[3].detail == "HTTP 404"
    assert asked == {"a": 1, "b/1": 1, "late": 3, "gone": 1, "down": 3, "hot": 1}
    assert most[0] <= 2
    assert details.detailed(rows.limit(0), "k", "id", address=address).count() == 0
