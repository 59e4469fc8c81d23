"""Operations that training-data pipelines need; nothing else in the library imports this subpackage."""
