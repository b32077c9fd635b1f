import io
import threading

import pytest

from tessera.cli import repl, statements
from tessera.session import Engine
from tessera.streaming import protocol as p
from tessera.streaming.client import Connection, ServerError
from tessera.streaming.server import Server


def test_frames_round_trip():
    values = [None, True, False, -(1 << 63), 1.5, "ä", b"\0\1", [1, "x"]]
    assert p.read_row(p.row(values)) == values
    assert p.read_schema(p.schema([("a", "bigint"), ("ä", "string")])) == [("a", "bigint"), ("ä", "string")]
    stream = io.BytesIO(p.frame(p.ROW, b"x" * 300) + p.frame(p.END))
    assert p.read_frame(stream) == (p.ROW, b"x" * 300) and p.read_frame(stream) == (p.END, b"") and p.read_frame(stream) is None
    for n in (0, 127, 128, 1 << 40):
        assert p.read_varint(p.varint(n), 0)[0] == n


def test_server_and_client(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/db")
    with Server(engine, port=0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with Connection(port=server.server_address[1]) as c:
            assert c.query("CREATE TABLE t (id INT, v TEXT)") == 1
            assert c.query("INSERT INTO t VALUES (1, 'x'), (2, NULL);") == 2
            table = c.query("SELECT * FROM t ORDER BY id")
            assert table.columns == [("id", "bigint"), ("v", "string")] and table.rows == [[1, "x"], [2, None]]
            with pytest.raises(ServerError):
                c.query("SELECT nothing FROM t")
            for text in ("SELECT " + "(" * 1000 + "id" + ")" * 1000 + " FROM t", "SELECT id" + " + 1" * 5000 + " FROM t", "SELECT 1 / 0 AS v FROM t"):
                with pytest.raises(ServerError):
                    c.query(text)
            c.query("BEGIN TRANSACTION")
            c.query("DELETE FROM t")
        with Connection(port=server.server_address[1]) as c:  # the lost transaction was rolled back
            assert len(c.query("SELECT * FROM t").rows) == 2
        server.shutdown()


def test_what_is_no_frame_is_answered(spark, tmp_path):
    import socket

    with Server(Engine(spark, f"file://{tmp_path}/db"), port=0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with socket.create_connection(("127.0.0.1", server.server_address[1]), 10) as s:
            s.sendall(b"\xff" * 20)
            s.shutdown(socket.SHUT_WR)
            with s.makefile("rb") as stream:
                assert p.read_frame(stream)[0] == p.ERROR and p.read_frame(stream) == (p.END, b"") and p.read_frame(stream) is None
        server.shutdown()


def test_prompt():
    assert list(statements(iter(["INSERT INTO t VALUES ('a;\n", "b', \"c;'\n", "\");\n", "SELECT b;\n"]))) == ["INSERT INTO t VALUES ('a;\nb', \"c;'\n\");", "SELECT b;"]
    assert list(statements(iter(["SELECT a\n", "FROM t;\n", ".quit\n", "SELECT b;\n"]))) == ["SELECT a\nFROM t;"]
    out = io.StringIO()
    repl(lambda s: str(1 // (s != "bad;")), iter(["bad;\n", "good;\n"]), out)
    assert out.getvalue().splitlines()[0].startswith("error:") and out.getvalue().splitlines()[1] == "1"
