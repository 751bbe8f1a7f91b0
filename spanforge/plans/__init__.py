"""The catalogue of runnable queries and the SQL that checks them."""
