"""What can go wrong with a request, each with a short kind and the exit code of a refusal."""


class LecternError(Exception):
    kind, exit_code = "error", 2


class NothingIndexed(LecternError):
    kind = "nothing_indexed"


class NotEmbedded(LecternError):
    kind = "not_embedded"


class NotRouted(LecternError):
    kind = "not_routed"


class BadOption(LecternError):
    kind = "bad_option"


class ScopeMissed(LecternError):
    """Patterns of a scope that match no book."""

    kind = "scope_missed"

    def __init__(self, patterns: list[str]) -> None:
        super().__init__(f"no book matches {', '.join(patterns)}")
        self.patterns = patterns


class SetAside(LecternError):
    kind = "set_aside"


class UnknownBook(LecternError):
    kind = "unknown_book"


class AmbiguousModel(LecternError):
    kind = "ambiguous_model"

    def __init__(self, choices: list[str]) -> None:
        super().__init__(f"several models fit: {', '.join(choices)}" if choices else "no model fits")
        self.choices = choices


class Busy(LecternError):
    """Another writer changed the index meanwhile."""

    kind = "busy"


class UnknownLibrary(LecternError):
    kind = "unknown_library"


class BadName(LecternError):
    """A name that can be no part of a path nor a word of a command."""

    kind = "bad_name"


class NothingToIngest(LecternError):
    """No file of a wanted kind; ``found`` are the commonest suffixes there."""

    kind = "nothing_to_ingest"

    def __init__(self, wanted: tuple[str, ...], found: list[str]) -> None:
        super().__init__(f"no file ends in {', '.join(wanted)}; there are: {', '.join(found) or 'none'}")
        self.wanted, self.found = wanted, found


class OtherChunking(LecternError):
    """A model's vectors are of one chunking only."""

    kind = "other_chunking"


class WrongDimension(LecternError):
    kind = "wrong_dimension"


class CarriesWait(LecternError):
    """Vectors of edited books that no embedding has taken over yet."""

    kind = "carries_wait"


class Damaged(LecternError):
    """Parts that are missing or not what was recorded."""

    kind = "damaged"

    def __init__(self, said: str, missing: list[str], changed: list[str]) -> None:
        super().__init__(f"{said}: missing {', '.join(missing) or 'none'}; changed {', '.join(changed) or 'none'}")
        self.missing, self.changed = missing, changed


class Cancelled(LecternError):
    """A search that was told to stop."""

    kind, exit_code = "cancelled", 130
