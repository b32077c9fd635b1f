"""The client of the TCP server; it needs no Spark."""

from __future__ import annotations

import socket
from dataclasses import dataclass

from tessera.streaming import protocol as p
from tessera.streaming.rows import text_table


class ServerError(Exception):
    """The server's answer to a statement that failed."""


@dataclass
class Table:
    columns: list[tuple[str, str]]
    rows: list[list]

    def to_text(self) -> str:
        return text_table([n for n, _ in self.columns], self.rows)


class Connection:
    def __init__(self, host: str = "127.0.0.1", port: int = 4000):
        self._socket = socket.create_connection((host, port))
        self._in, self._out = self._socket.makefile("rb"), self._socket.makefile("wb")

    def query(self, sql: str) -> Table | int:
        """Rows, or the number of affected rows."""
        self._send(p.frame(p.QUERY, sql.encode()))
        columns, rows, affected, error = None, [], 0, None
        while True:
            got = p.read_frame(self._in)
            if got is None:
                raise ConnectionError("the server closed the connection")
            tag, payload = got
            if tag == p.END:
                break
            if tag == p.SCHEMA:
                columns = p.read_schema(payload)
            elif tag == p.ROW:
                rows.append(p.read_row(payload))
            elif tag == p.AFFECTED:
                affected, _ = p.read_varint(payload, 0)
            elif tag == p.ERROR:
                error = payload.decode()
        if error is not None:
            raise ServerError(error)
        return affected if columns is None else Table(columns, rows)

    def _send(self, data: bytes) -> None:
        self._out.write(data)
        self._out.flush()

    def close(self) -> None:
        try:
            self._send(p.frame(p.CLOSE))
        except OSError:
            pass
        self._socket.close()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
