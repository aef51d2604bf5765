"""Mail accounts as a Spark source: `spark.read.format("mailbox")` and `spark.readStream.format("mailbox")`.

Every account is a partition of its own, read where Spark runs it. Filters on the account prune partitions before anything is read;
filters on the message id and on words in sender, subject or snippet are left to the connector. A connector is what talks to a
provider; the one here reads a folder with a sub-folder for each account (`account_id=NAME`), whose files hold a message in each line.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains

from leafloom.functions.text import strip_tags

from .files import message_fields

SCHEMA = "account_id string, id string, sender string, subject string, date timestamp, snippet string, plain string, markup string"
#: Fields in which a connector can look for words, by SCHEMA's names.
SOUGHT = ("sender", "subject", "snippet")


class Connector:
    """What a provider must offer. Positions are JSON values that only the connector reads; None is the beginning."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def accounts(self) -> list[str]:
        raise NotImplementedError

    def position(self, account: str):
        """Where the account's messages end now."""
        raise NotImplementedError

    def messages(self, account: str, begin=None, end=None) -> Iterator[dict]:
        """The provider's messages of an account between two positions, oldest first."""
        raise NotImplementedError

    def message(self, account: str, message_id: str) -> dict | None:
        return next((m for m in self.messages(account) if m.get("id") == message_id), None)


class FolderConnector(Connector):
    """Messages as JSON lines under `path`/account_id=NAME/; files only grow, and new ones may come. Lines that are no JSON object are passed over."""

    PREFIX = "account_id="

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.root = Path(options["path"].removeprefix("file://").removeprefix("file:"))

    def accounts(self) -> list[str]:
        return sorted(unquote(d.name.removeprefix(self.PREFIX)) for d in self.root.iterdir() if d.is_dir() and d.name.startswith(self.PREFIX))

    def _files(self, account: str) -> list[Path]:
        home = next((d for d in self.root.iterdir() if d.is_dir() and unquote(d.name) == self.PREFIX + account), None)
        return sorted(f for f in home.iterdir() if f.is_file() and f.name[0] not in "._") if home else []

    def position(self, account: str) -> dict[str, int]:
        return {f.name: f.stat().st_size for f in self._files(account)}

    def messages(self, account, begin=None, end=None):
        for f in self._files(account):
            upto = f.stat().st_size if end is None else end.get(f.name, 0)
            with f.open("rb") as lines:
                lines.seek((begin or {}).get(f.name, 0))
                while lines.tell() < upto and (line := lines.readline()):
                    try:
                        got = json.loads(line)
                    except ValueError:
                        continue
                    if isinstance(got, dict):
                        yield got


def _connector(options: dict[str, str]) -> Connector:
    """The class that option `connector` names as module:Class, else that of folders."""
    module, _, name = options.get("connector", "").partition(":")
    return (getattr(importlib.import_module(module), name) if name else FolderConnector)(options)


class Account(InputPartition):
    def __init__(self, account: str, begin=None, end=None):
        self.account, self.begin, self.end = account, begin, end


class _Reads:
    """Rows of one account's messages that pass what was left to the connector."""

    options: dict[str, str]
    ids: list[str] | None = None
    words: tuple[tuple[str, str], ...] = ()

    def rows(self, part: Account) -> Iterator[tuple]:
        mail = _connector(self.options)
        raw = mail.messages(part.account, part.begin, part.end) if self.ids is None else filter(None, (mail.message(part.account, i) for i in self.ids))
        for m in raw:
            x = message_fields(m)
            if all(w in (x[c] or "") for c, w in self.words):
                yield (part.account, x["id"], x["sender"], x["subject"], x["date"], x["snippet"], x["plain"], x["markup"])


class MailReader(_Reads, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.asked = options, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name == "account_id" and values is not None:
                self.asked = values if self.asked is None else self.asked & values
            elif name == "id" and values is not None:
                self.ids = sorted(values if self.ids is None else set(self.ids) & values)
            elif name in SOUGHT and isinstance(f, StringContains):
                self.words = (*self.words, (name, f.value))
            else:
                yield f

    def partitions(self) -> list[Account]:
        return [Account(a) for a in _connector(self.options).accounts() if self.asked is None or a in self.asked]

    def read(self, partition: Account) -> Iterator[tuple]:
        return self.rows(partition)


class MailStream(_Reads, DataSourceStreamReader):
    """Offsets are every account's position; a batch has a partition for each account that has grown."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        mail = _connector(self.options)
        return {a: mail.position(a) for a in mail.accounts()}

    def partitions(self, start: dict, end: dict) -> list[Account]:
        return [Account(a, start.get(a), upto) for a, upto in end.items() if start.get(a) != upto]

    def read(self, partition: Account) -> Iterator[tuple]:
        return self.rows(partition)


class MailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MailReader:
        return MailReader(dict(self.options))

    def streamReader(self, schema) -> MailStream:  # noqa: N802
        return MailStream(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Makes format("mailbox") known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailSource)
    return spark


def with_body(mail: DataFrame) -> DataFrame:
    """Messages with body in the place of plain and markup: the plain text, else the text of the HTML."""
    return mail.withColumn("body", F.coalesce("plain", strip_tags(F.coalesce("markup", F.lit(""))))).drop("plain", "markup")


def read_mail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """MESSAGE_SCHEMA of all accounts under a path; filter it by account_id, id, or words in sender, subject and snippet."""
    return with_body(register(spark).read.format("mailbox").options(path=path, **options).load())


def stream_mail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same as messages come."""
    return with_body(register(spark).readStream.format("mailbox").options(path=path, **options).load())


def write_folder(messages: DataFrame, path: str) -> None:
    """messages (account_id, value: a provider's message as JSON text) as the folder that FolderConnector reads."""
    messages.select("account_id", "value").write.mode("append").partitionBy("account_id").text(path)
