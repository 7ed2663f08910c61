"""DataFrame jobs: frames in, frames out, nothing collected on the driver."""
