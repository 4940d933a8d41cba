"""The one exception of the engine; its code is part of the command language's contract."""


class Failure(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message
