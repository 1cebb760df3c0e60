"""The dialect: tokens, statements and their parser."""
