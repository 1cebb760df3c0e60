"""The SQL server: a session for each connection, statements line by line."""

from __future__ import annotations

import socketserver
import threading

from ..session import Session
from ..status import InvalidArgument, StatusError
from ..store import Database
from . import protocol as P

HOST, PORT, MAX_CLIENTS = "127.0.0.1", 7380, 128


class Connection:
    """What a client has sent so far, and its session.  Needs no socket."""

    def __init__(self, session: Session):
        self.session, self.buffer = session, ""

    def reset(self) -> None:
        self.buffer = ""
        if self.session.in_transaction():
            self.session.execute("ABORT;")

    def line(self, line: str) -> tuple[str, bool]:
        """The reply to a line, empty while a statement is unfinished, and
        whether the connection stays open."""
        if not self.buffer:
            match line.strip().upper():
                case "":
                    return "", True
                case "PING":
                    return "+PONG\n", True
                case "QUIT":
                    return "+OK\n", False
                case "STATUS":
                    return P.encode_status(self.session.in_transaction()), True
                case "RESET":
                    return self._told(lambda: self.reset() or "+OK\n"), True
        text = f"{self.buffer}\n{line}" if self.buffer else line
        if len(text.encode()) > P.MAX_STATEMENT:
            self.buffer = ""
            return P.encode_error(InvalidArgument("statement too large")), True
        self.buffer = text
        if not P.is_terminated(text):
            return "", True
        self.buffer = ""
        return self._told(lambda: P.encode_result(self.session.execute(text))), True

    @staticmethod
    def _told(work) -> str:
        try:
            return work()
        except StatusError as e:
            return P.encode_error(e)


class _Handler(socketserver.StreamRequestHandler):
    server: SqlServer

    def handle(self) -> None:
        if not self.server.slots.acquire(blocking=False):
            self.wfile.write(P.encode_error(InvalidArgument("too many connections")).encode())
            return
        connection = Connection(Session(self.server.db))
        try:
            open_ = True
            while open_ and (raw := self.rfile.readline(P.MAX_STATEMENT + 2)):
                if not raw.endswith(b"\n") and len(raw) > P.MAX_STATEMENT:
                    break
                reply, open_ = connection.line(raw.decode("utf-8", "replace").rstrip("\n").replace("\r", ""))
                if reply:
                    self.wfile.write(reply.encode())
        except OSError:
            pass
        finally:
            connection.reset()
            self.server.slots.release()


class SqlServer(socketserver.ThreadingTCPServer):
    allow_reuse_address = daemon_threads = True

    def __init__(self, db: Database, host: str = HOST, port: int = PORT, max_clients: int = MAX_CLIENTS):
        self.db, self.slots = db, threading.Semaphore(max_clients)
        super().__init__((host, port), _Handler)

    @property
    def port(self) -> int:
        return self.server_address[1]

    def start(self) -> threading.Thread:
        thread = threading.Thread(target=self.serve_forever, daemon=True)
        thread.start()
        return thread

    def stop(self) -> None:
        self.shutdown()
        self.server_close()
