"""Tables, frames and documents the operators read and write."""
