"""No work here is a stream: panels are monthly batches, and banding is a window over months."""
