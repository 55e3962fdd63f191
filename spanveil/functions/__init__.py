"""Column functions: regular expressions, text, arrays, dictionaries, pseudonyms."""
