"""Questions to a resolver and its answers: prompts, replies as text, and what becomes of the lines that asked."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderweave.functions import text as T
from orderweave.operators.linkage import KEY, MISSING, TIMEOUT

# The reply that stands for a timeout, and the reply when there is no resolver.
TIMED_OUT, UNAVAILABLE = "LLM request timeout", "LLM Fallback unavaliable"
REPLY = "selected_nomenclature_code string, confidence double, reasoning string"
ASKED = 5
# What is tried once more and after how long, how long a refused key rests, how many questions go at once.
RETRY_CODES, RETRY_WORDS = {429, 504}, ("504", "429", "DEADLINE_EXCEEDED", "RESOURCE_EXHAUSTED", "TOO MANY REQUESTS")
RETRY_AFTER, REST, AT_ONCE = 1.5, 60.0, 8


def prompt(ratio: Column, dimensions: Column, candidates: Column) -> Column:
    """The question for a line with client_description, factory_alias and item_type, and its best candidates.

    ``candidates`` is an array of (code, nomenclature, module, color, filling, packaging, score), best first.
    """
    # The wording, which the resolver is tuned to.
    dash = lambda c, x: F.coalesce(T.optional_text(c[x]), F.lit("-"))
    line = lambda c, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] Код: "), c["code"], F.lit(" | Номенклатура: "), c["nomenclature"], F.lit(" | Модуль: "), dash(c, "module"), F.lit(" | Цвет: "), dash(c, "color"),
        F.lit(" | Начинка: "), dash(c, "filling"), F.lit(" | Упаковка: "), dash(c, "packaging"), F.lit(" | Скор сходства: "), F.format_string("%.2f", c["score"]),
    )
    head = (
        "Ты эксперт мебельного склада. Выбери точный nomenclature_code кандидата, который соответствует заказу с учётом модели, цвета, размеров и упаковки. "
        "Если это составное стекло (IMP ст), выбери стекло подходящей толщины и габаритов. "
        "Упаковка места (1/3, 2/2 и т.д.) должна совпадать точно: нельзя выбирать Ун1/1 или 1/1 вместо многоместной 1/3. "
        "Корпус кухни нельзя заменять ящиком или направляющими. Если ни один кандидат не подходит, верни selected_nomenclature_code = null.\n\n"
        "Данные строки 1С 7.7:\n- Клиентское наименование: "
    )
    sizes = F.when(F.size(dimensions) > 0, F.array_join(dimensions, ", ")).otherwise("не указаны")
    return F.concat(
        F.lit(head), F.col("client_description"), F.lit("\n- Фабричный алиас: "), F.coalesce("factory_alias", F.lit("None")), F.lit("\n- Тип позиции: "), F.coalesce("item_type", F.lit("")), F.lit("\n- Габариты: "), sizes,
        F.lit("\n- Упаковка: "), F.coalesce(ratio, F.lit("не указана")), F.lit("\n\nКандидаты из каталога 1С v8 (ТОП-5):\n"), F.array_join(F.transform(F.slice(candidates, 1, ASKED), line), "\n"),
        F.lit("\n\nОтветь строго JSON с полями: selected_nomenclature_code (string или null), confidence (0.0-1.0), reasoning (кратко на русском)."),
    )


def json_text(reply: Column) -> Column:
    """A reply without its fence: from the first brace to the last, if there are any."""
    bare = F.trim(F.regexp_replace(F.trim(reply), r"(?im)^```(?:json)?\s*\n?", ""))
    bare = F.trim(F.regexp_replace(bare, r"```$", ""))
    return F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")), bare)


def parse_reply(reply: Column) -> Column:
    """A struct of code, confidence and reasoning; a reply that isn't JSON has no code."""
    x = F.from_json(json_text(reply), REPLY)
    return F.struct(T.optional_text(x["selected_nomenclature_code"]).alias("code"), F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(F.trim(x["reasoning"]), F.lit(UNAVAILABLE)).alias("reasoning"))


def merge_answers(lines: DataFrame, answers: DataFrame, catalog: DataFrame, reason: Column, provider: str = "llm") -> DataFrame:
    """What lines become by ``answers(job_key, code, confidence, reasoning)``: one row for each of ``lines``.

    ``lines`` has the key, job_key and what ``reason`` reads; ``catalog`` has code, barcode, nomenclature and the
    rest of what ``reason`` reads. A code counts if the catalog has it (leading zeros aside) and no constraint is
    broken (``reason`` is null); equal lines share an answer, but each is held against the constraints itself.
    """
    plain = lambda c: F.regexp_replace(F.trim(c), "^0+", "")
    exact = catalog.select(F.col("code").alias("asked"), F.col("code").alias("exact"))
    loose = catalog.where(plain(F.col("code")) != "").groupBy(plain(F.col("code")).alias("bare")).agg(F.min("code").alias("loose"))
    a = answers.select("job_key", F.col("code").alias("asked"), "confidence", "reasoning")
    a = a.join(exact, "asked", "left").join(loose, plain(F.col("asked")) == F.col("bare"), "left").select("job_key", F.coalesce("exact", "loose").alias("code"), "confidence", "reasoning")
    j = lines.join(a, "job_key", "left").join(catalog, "code", "left")
    late = F.coalesce(F.col("reasoning") == TIMED_OUT, F.lit(False))
    taken = ~late & F.col("code").isNotNull() & reason.isNull()
    j = j.withColumns({"late": late, "taken": taken})
    only = lambda c: F.when(F.col("taken"), F.col(c))
    method = F.when(F.col("taken"), F.when(T.optional_text(F.col("barcode")).isNotNull(), F.lit(f"LLM_{provider.upper()}")).otherwise("LLM_NO_BARCODE")).when(F.col("late"), "LLM_TIMEOUT")
    detail = F.when(F.col("late"), TIMEOUT).when(~F.col("taken"), MISSING)
    return j.select(
        *KEY, F.when(F.col("taken"), "MATCHED_LLM").otherwise("QUARANTINE").alias("status"), only("code").alias("code"), only("nomenclature").alias("nomenclature"), only("barcode").alias("barcode"),
        only("confidence").alias("confidence"), method.alias("match_method"), detail.alias("status_detail"),
    )


def may_retry(error: BaseException) -> bool:
    """Timeouts and refusals for too many requests."""
    codes = {getattr(error, "status_code", None), getattr(error, "code", None)}
    return isinstance(error, TimeoutError) or bool(codes & RETRY_CODES) or any(w in str(error).upper() for w in RETRY_WORDS)


def call_with_retry(call: Callable, delay: float = RETRY_AFTER, retry_on: Callable[[BaseException], bool] = may_retry):
    """``call()``, and once more after a delay if the first error is one to retry."""
    try:
        return call()
    except Exception as error:
        if not retry_on(error):
            raise
    time.sleep(delay)
    return call()


class KeyRing:
    """Keys handed out in turn; one that was refused rests for a while."""

    def __init__(self, keys: list[str], rest: float = REST, clock: Callable[[], float] = time.monotonic):
        self.keys, self.rest, self.clock = [k.strip() for k in keys if k.strip()], rest, clock
        self.next, self.until, self.lock = 0, {}, threading.Lock()

    def take(self) -> str | None:
        """The next key that doesn't rest, or None."""
        with self.lock:
            now = self.clock()
            for _ in self.keys:
                key = self.keys[self.next]
                self.next = (self.next + 1) % len(self.keys)
                if self.until.get(key, now) <= now:
                    return key
        return None

    def refuse(self, key: str) -> None:
        with self.lock:
            self.until[key] = self.clock() + self.rest


def resolve(jobs: DataFrame, ask: Callable[[str, str | None], str] | None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``jobs(job_key, prompt)`` to (job_key, code, confidence, reasoning), a few questions at once in each task.

    ``ask(prompt, key)`` gives the reply as text. A call that may be tried again is, with the next key; one that
    times out twice is answered as timed out, one that fails otherwise, or is not asked, as unavailable.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = KeyRing(list(keys))

        def one(prompt: str) -> str:
            def call() -> str:
                key = ring.take()
                try:
                    return ask(prompt, key)
                except Exception as error:
                    if key is not None and may_retry(error):
                        ring.refuse(key)
                    raise

            told = lambda why: '{"reasoning": "' + why + '"}'
            if ask is None:
                return told(UNAVAILABLE)
            try:
                return call_with_retry(call)
            except TimeoutError:
                return told(TIMED_OUT)
            except Exception:  # an answer all the same, without a code
                return told(UNAVAILABLE)

        with ThreadPoolExecutor(AT_ONCE) as pool:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(pool.map(one, b.column(1).to_pylist())), pa.string())], names=["job_key", "reply"])

    said = jobs.select("job_key", "prompt").mapInArrow(run, "job_key string, reply string")
    return said.select("job_key", parse_reply(F.col("reply")).alias("x")).select("job_key", "x.*")
