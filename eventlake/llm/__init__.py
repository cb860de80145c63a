"""Operations for pipelines that prepare training data.

Each module holds one operator with a general interface (frames in, frames out; columns are named by parameters, other
columns never matter). ``queries`` registers the thin queries over the shared tables. Nothing outside imports this package.
"""
