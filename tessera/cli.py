"""Command line: a shell on a store, a server, and a client of a server.

    python -m tessera.cli shell  --store DIR [-c SQL | --file PATH]
    python -m tessera.cli serve  --store DIR [--host H] [--port N]
    python -m tessera.cli client [--host H] [--port N] [-c SQL | --file PATH]
"""

from __future__ import annotations

import argparse
import socket
import sys
from collections import deque
from collections.abc import Callable
from typing import TextIO

from .result import text_of
from .server import protocol as P
from .server.sql_server import HOST, PORT, SqlServer
from .session import Session
from .status import StatusError

HISTORY = 50
HELP = "Statements end with ;   .history shows past ones   .quit leaves\n"


def prompt(buffer: str, in_txn: bool) -> str:
    """What the shell shows: an open quote, an open transaction, or neither."""
    if buffer and buffer.count("'") % 2:
        return "sql'> "
    return "sql*> " if in_txn else "sql> "


def run_script(run: Callable[[str], str], script: str, out: TextIO) -> None:
    """Statements one by one, as a client sends them."""
    for statement in P.statements(script):
        out.write(run(statement if statement.endswith(";") else f"{statement};"))


def shell(run: Callable[[str], str], in_txn: Callable[[], bool], lines: TextIO, out: TextIO, show_prompt: bool = True) -> None:
    buffer, history = "", deque(maxlen=HISTORY)
    while True:
        if show_prompt:
            out.write(prompt(buffer, in_txn()) if not buffer or buffer.count("'") % 2 else "  -> ")
            out.flush()
        line = lines.readline()
        if not line:
            return
        line = line.rstrip("\n")
        if not buffer and line.strip().startswith("."):
            match line.strip():
                case ".quit" | ".exit":
                    return
                case ".history":
                    out.writelines(f"{h}\n" for h in history)
                case _:
                    out.write(HELP)
            continue
        if not buffer and not line.strip():
            continue
        buffer = f"{buffer}\n{line}" if buffer else line
        if P.is_terminated(buffer):
            history.append(buffer)
            out.write(run(buffer))
            buffer = ""


def local(session: Session) -> Callable[[str], str]:
    def run(sql: str) -> str:
        try:
            return text_of(session.execute(sql))
        except StatusError as e:
            return f"{e}\n"

    return run


class Client:
    """A connection to a SQL server."""

    def __init__(self, host: str = HOST, port: int = PORT):
        self.socket = socket.create_connection((host, port))
        self.file = self.socket.makefile("rwb")

    def send(self, line: str) -> P.Reply:
        self.file.write(line.encode() + b"\n")
        self.file.flush()
        lines = [self.file.readline().decode()]
        while lines[-1] and not P.reply_complete(lines[0]) and lines[-1] != "*END\n":
            lines.append(self.file.readline().decode())
        return P.decode_reply("".join(lines))

    def run(self, sql: str) -> str:
        reply = self.send(sql)
        if reply.kind == "error":
            return f"{reply.message}\n"
        reply.result.rows_affected = reply.rows_affected
        return text_of(reply.result)

    def in_txn(self) -> bool:
        return bool(self.send("STATUS").in_txn)

    def close(self) -> None:
        self.file.close()
        self.socket.close()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("mode", choices=["shell", "serve", "client"])
    parser.add_argument("--store")
    parser.add_argument("--host", default=HOST)
    parser.add_argument("--port", type=int, default=PORT)
    parser.add_argument("-c", dest="sql")
    parser.add_argument("--file")
    given = parser.parse_args(args)
    script = given.sql
    if given.file:
        with open(given.file, encoding="utf-8") as f:
            script = f.read()
    if given.mode == "client":
        client = Client(given.host, given.port)
        try:
            if script is not None:
                run_script(client.run, script, sys.stdout)
            else:
                shell(client.run, client.in_txn, sys.stdin, sys.stdout, sys.stdin.isatty())
        finally:
            client.close()
        return 0
    if not given.store:
        parser.error("--store is needed")
    from pyspark.sql import SparkSession

    from .store import Database

    with Database(SparkSession.builder.getOrCreate(), given.store) as db:
        if given.mode == "serve":
            server = SqlServer(db, given.host, given.port)
            try:
                server.serve_forever()
            except KeyboardInterrupt:
                server.server_close()
            return 0
        session = Session(db)
        if script is not None:
            run_script(local(session), script, sys.stdout)
        else:
            shell(local(session), session.in_transaction, sys.stdin, sys.stdout, sys.stdin.isatty())
    return 0


if __name__ == "__main__":
    sys.exit(main())
