"""A TCP server: one session per connection. Rows are sent as partitions arrive, not collected."""

from __future__ import annotations

import socketserver

from tessera.errors import SqlError
from tessera.session import Engine
from tessera.streaming import protocol as p


class _Connection(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        session = self.server.engine.session()
        try:
            while (got := p.read_frame(self.rfile)) is not None and got[0] != p.CLOSE:
                self._answer(session, *got)
        except ValueError as e:  # no frame: what follows can't be told apart, so the answer is the last one
            self.wfile.write(p.frame(p.ERROR, str(e).encode()) + p.frame(p.END))
        finally:  # a lost connection rolls its transaction back
            session.close()

    def _answer(self, session, tag: int, payload: bytes) -> None:
        send = self.wfile.write
        try:
            if tag != p.QUERY:
                raise SqlError(f"unexpected message {chr(tag)}")
            result = session.sql(payload.decode())
            if result.df is None:
                send(p.frame(p.AFFECTED, p.varint(result.rows_affected)))
            else:
                send(p.frame(p.SCHEMA, p.schema([(f.name, f.dataType.simpleString()) for f in result.df.schema.fields])))
                for values in result:
                    send(p.frame(p.ROW, p.row(values)))
        except OSError:  # the client is gone
            raise
        except Exception as e:  # whatever fails is an answer; the connection goes on
            send(p.frame(p.ERROR, (str(e) or type(e).__name__).encode()))
        send(p.frame(p.END))


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address, daemon_threads = True, True

    def __init__(self, engine: Engine, host: str = "127.0.0.1", port: int = 4000):
        self.engine = engine
        super().__init__((host, port), _Connection)


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 4000) -> None:
    with Server(engine, host, port) as server:
        server.serve_forever()
