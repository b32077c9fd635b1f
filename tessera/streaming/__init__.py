"""Row delivery: iterators, wire protocol, server and client."""
