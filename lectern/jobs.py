"""Searches that run beside their caller: a frame for each stage, exactly one last frame, and a way to stop them."""

from __future__ import annotations

import json
import queue
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark import InheritableThread

from lectern import errors as E

Frame = dict[str, object]


class Frames:
    """Says what stage a search has come to. The last frame has ``state`` done, cancelled or failed, and nothing follows it."""

    def __init__(self, say: Callable[[Frame], None] | None = None, stopped: Callable[[], bool] = lambda: False) -> None:
        self._say, self._stopped, self._begun, self._ended = say, stopped, time.time(), False

    def _put(self, **frame: object) -> None:
        if self._say and not self._ended:
            self._say({**frame, "ms": round(1000 * (time.time() - self._begun), 1)})

    def stage(self, name: str, **more: object) -> None:
        """A stage begins. A search that was told to stop ends here, if Spark has not ended it yet."""
        if self._stopped():
            raise E.Cancelled("the search was stopped")
        self._put(stage=name, state="running", **more)

    def end(self, error: BaseException | None = None, **more: object) -> None:
        state = "done" if error is None else "cancelled" if self._stopped() or isinstance(error, E.Cancelled) else "failed"
        if state == "failed":
            more["error"] = getattr(error, "kind", type(error).__name__)
        self._put(stage="end", state=state, final=True, **more)
        self._ended = True


class SearchJob:
    """One search of an engine in a thread of its own; its Spark jobs bear a tag by which they are cancelled."""

    def __init__(self, engine, question: str, **more: object) -> None:  # noqa: ANN001
        self.tag, self._stop, self._frames = f"lectern-{uuid.uuid4().hex}", False, queue.Queue()
        self._engine, self._question, self._more = engine, question, more
        self._result, self._error = None, None
        self._thread = InheritableThread(target=self._run, session=engine.spark)
        self._thread.start()

    def _run(self) -> None:
        context = self._engine.spark.sparkContext
        context.addJobTag(self.tag)
        context.setInterruptOnCancel(True)
        try:
            self._result = self._engine.search(self._question, frames=Frames(self._frames.put, lambda: self._stop), **self._more)
        except BaseException as e:  # noqa: BLE001  the caller gets it from result()
            self._error = e
        finally:
            context.removeJobTag(self.tag)

    def cancel(self) -> None:
        """Stop it, whatever stage it is in; other searches go on."""
        self._stop = True
        self._engine.spark.sparkContext.cancelJobsWithTag(self.tag)

    def frames(self) -> Iterator[Frame]:
        """Frames as they come, up to the last."""
        while True:
            frame = self._frames.get()
            yield frame
            if frame.get("final"):
                return

    def lines(self) -> Iterator[str]:
        """Frames as lines of JSON."""
        return (json.dumps(f, ensure_ascii=False) for f in self.frames())

    def result(self, timeout: float | None = None):  # noqa: ANN201
        """What the search found; raises what ended it, ``Cancelled`` if it was stopped."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError("the search is still running")
        if self._stop and self._error is not None:
            raise E.Cancelled("the search was stopped") from self._error
        if self._error is not None:
            raise self._error
        return self._result
