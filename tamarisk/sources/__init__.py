"""Request bodies, configuration files and other inputs."""
