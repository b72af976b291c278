"""Tables: what they are called, how they are read, what counts as missing in them."""
