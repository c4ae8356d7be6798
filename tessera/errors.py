"""Errors of the engine."""


class TokenizerError(Exception):
    prefix = ""

    def __init__(self, message: str):
        super().__init__(self.prefix + message)


class TokenizerFileNotFound(TokenizerError):
    prefix = "File not found error: "


class TokenNotFound(TokenizerError):
    prefix = "Token not found in vocabulary: "


class TokenizerValueError(TokenizerError):
    prefix = "Value error: "


class VocabularyParsingError(TokenizerError):
    prefix = "Vocabulary parsing error: "
